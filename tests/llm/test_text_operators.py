import base64
import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from normloom.llm import byte_bpe, chat_format, exact_dedup, license_scan, queries, sharding, shared

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, shard string, KEY int"
#: Nulls, empty and blank texts, ties, repeated rows, a very long text; columns whose names the operators also use.
ODD = [(1, None, "x", 1), (None, "a b", "x", 2), (2, "", None, 3), (3, " \t\n", "x", 4), (4, "a b", "x", 5), (5, "b a", "x", None), (5, "b a", "x", None), (6, "ab ", "x", 7), (7, "word " * 60_000, "x", 8), (8, "é漢😀\x00", "x", 9), (None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def table_rows(spark, name="documents"):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


@pytest.fixture(scope="module")
def reference_encoding():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_replay_equals_tiktoken_on_odd_texts(reference_encoding):
    random.seed(3)
    replay = byte_bpe.Replay(byte_bpe.vocabulary(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))), public_tokenizers.PATTERN, kept=50)
    texts = ["", "a" * 4000, "ab" * 3000, " " * 500 + "x", "I'll  don't\n\n\n  x", "À漢字😀👩‍👧\x00\x1f"]
    texts += ["".join(random.choice("aehinorst  .,'éß\n漢7") for _ in range(random.randrange(400))) for _ in range(60)]
    got = byte_bpe.pa.array(texts)
    ids = replay.encode(got).to_pylist()
    assert ids == [reference_encoding.encode_ordinary(t) for t in texts]
    assert replay.decode(byte_bpe.pa.array(ids, byte_bpe.pa.list_(byte_bpe.pa.int32()))).to_pylist() == [t.encode() for t in texts]


def test_op1_equals_tiktoken(spark, reference_encoding):
    got = {r.doc_id: r for r in queries.op1_byte_bpe(spark, SF).collect()}
    for d in table_rows(spark):
        ids = reference_encoding.encode_ordinary(d.text)
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(d.text.encode()).hexdigest())


def test_bpe_odd_rows(spark, odd, none):
    bpe = byte_bpe.ByteBpe(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = bpe.decode(bpe.encode(odd)).collect()
    assert len(rows) == len(ODD) and all(bytes(r.decoded) == (r.text or "").encode() for r in rows)
    assert bpe.decode(bpe.encode(none)).count() == 0


def jump(key, shards):
    at, following = -1, 0
    for i in range(1, shards + 1):
        if following >= shards:
            break
        at = following
        draw = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)) >> 33
        following = int((at + 1) * (2147483648.0 / (draw + 1)))
    return at


def test_op4_equals_brute_force(spark):
    rows, docs = queries.op4_jump_sharding(spark, SF).collect(), {d.doc_id: d.text for d in table_rows(spark)}
    for r in rows:
        text = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.shard, r.grown_shard) == (len(text) + 16, zlib.crc32(text), "key", jump(r.doc_id, 40), jump(r.doc_id, 41))
    assert len(rows) == len(docs) and all(r.grown_shard in (r.shard, 40) for r in rows)


def test_slots_are_gapless_with_many_buckets(spark, odd, none):
    rows = sharding.assign_shards(odd, shards=2, rows_per_bucket=1).collect()
    for shard in (0, 1):
        own = sorted(r.slot for r in rows if r.shard == shard)
        assert own == list(range(len(own)))
    assert {r.size for r in rows if r.text is None} == {16} and rows[0].__fields__.count("shard") == 1
    assert len({r.shard for r in rows if r.doc_id is None}) == 1 and sharding.assign_shards(none).count() == 0


def groups_by_hand(rows):
    found = {}
    for i, r in enumerate(rows):
        found.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append((-len(r[1] or ""), (r[0] is not None, r[0] or 0), i))
    return {i: (rows[min(v)[2]][0], len(v), k) for k, v in found.items() for _, _, i in v}


def test_exact_dedup_by_hand(odd, none):
    want = sorted((str(ODD[i][0]), str(keep), n, hashlib.sha256(k.encode()).hexdigest()) for i, (keep, n, k) in groups_by_hand(ODD).items())
    got = exact_dedup.duplicate_groups(odd).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    kept = exact_dedup.drop_duplicates(odd).collect()
    assert sorted(re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept) == sorted({k for _, _, k in groups_by_hand(ODD).values()})
    assert kept[0].__fields__ == ["doc_id", "text", "shard", "KEY"]
    assert exact_dedup.duplicate_groups(none).count() == 0 and exact_dedup.drop_duplicates(none).count() == 0


def test_filter_misses_no_repeat_and_a_full_one_changes_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(map(tuple, exact_dedup.duplicate_groups(docs).collect()))
    monkeypatch.setattr(exact_dedup, "FLUSH_ROWS", 7)
    assert sorted(map(tuple, exact_dedup.duplicate_groups(docs).collect())) == want
    # Set on the driver: workers import their own copy of the module, so a patched ``positions`` would reach only half of them.
    monkeypatch.setattr(exact_dedup, "repeated_filter", lambda hashes, bits: exact_dedup.np.full(2**bits // 8, 255, "u1"))
    assert sorted(map(tuple, exact_dedup.duplicate_groups(docs).collect())) == want


def test_no_control_string_survives_in_a_text(spark):
    texts = ["####", "### ###", "#####</turn></turn>", "\\###", "##\\#", "<\\/turn>", ""]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", chat_format.escaped(F.col("text"), chat_format.Template()).alias("shown"))
    for r in got.select("text", "shown", chat_format.unescaped(F.col("shown")).alias("back")).collect():
        assert r.back == r.text and "###" not in r.shown and "</turn>" not in r.shown


def test_op3_reads_back_every_turn(spark):
    sample = "\\### Assistant: </turn> ok"
    talks = {-7: [("user", sample), ("assistant", sample)]}
    for r in sorted(table_rows(spark, "conversations"), key=lambda r: r.turn):
        talks.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = {r.conv_id: r for r in queries.op3_chat_format(spark, SF).collect()}
    assert got.keys() == talks.keys()
    for conv, turns in talks.items():
        learned = "".join(t for role, t in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        roles = ["start", *(role for role, _ in turns)]
        broken = [i for i, pair in enumerate(zip(roles, roles[1:], strict=False)) if pair not in chat_format.Template().turns]
        assert (r.valid, r.first_error) == (not broken, min(broken, default=None))
    plan = queries.op3_chat_format(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" in plan


def test_chat_of_very_long_texts_and_roles(spark):
    long = ["r" * 1_000_000, ":~\\" * 100_000 + "###", "### " * 100_000]
    rows = [(i, 0, role, text) for i, role in enumerate(long) for text in [long[2 - i]]] + [(9, 0, "user", None), (9, 0, "user", None), (9, 1, "assistant", "x ~1 ~0 : \\")]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").withColumns({c: F.lit(1) for c in ("valid", "segments", "said", "formatted")})
    made = chat_format.format_conversations(turns).withColumn("back", chat_format.read_back(F.col("formatted")))
    for r in made.collect():
        assert [tuple(b) for b in r.back] == [(x[2], x[3] or "") for x in rows if x[0] == r.conv_id]


def test_chat_machine_and_escapes(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "assistant", "</turn"), (2, 1, "assistant", ">\n### User: hi</turn>\n\\"), (3, 0, None, None), (3, 1, "to\\ol:x", "\\\\###"), (None, None, "@System", ""), (4, 0, "user", "x"), (4, 0, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    made = chat_format.format_conversations(turns)
    got = {r.conv_id: r for r in made.withColumn("back", chat_format.read_back(F.col("formatted"))).collect()}
    assert {k: (r.valid, r.first_error) for k, r in got.items()} == {1: (True, None), 2: (False, 0), 3: (False, 0), None: (False, 0), 4: (False, 1)}
    for conv, r in got.items():
        want = [(x[2] or "", x[3] or "") for x in rows if x[0] == conv]
        assert [tuple(b) for b in r.back] == want and "".join(s.text for s in r.segments) == r.formatted
    assert chat_format.format_conversations(turns.limit(0)).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_by_hand(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for p, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))


def test_op10_base_columns_by_hand(spark, odd, none):
    extra = [(-90, "MIT-License, mit license; the Lesser General public\nLICENSE apache license", "s", 1), (-91, "license mit", "s", 1), (-92, "mit", None, None)]
    docs = odd.unionByName(spark.createDataFrame(extra, SCHEMA)).select("doc_id", "text").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    rows = license_scan.scan_licenses(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_by_hand(r.text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert {r.labels for r in rows if r.doc_id == -90} == {"apache,gpl,lgpl,mit"}
    assert license_scan.scan_licenses(none).count() == 0


def spans_by_hand(text):
    """Labels and best coverage by voting over all places, template by template."""
    ws, labels, score = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")), set(), 0.0
    for label, _, width, template in license_scan.templates():
        at = {}
        for j in range(len(template) - width + 1):
            at.setdefault(tuple(template[j : j + width]), []).append(j)
        lines = sorted({i - j for i in range(len(ws) - width + 1) for j in at.get(tuple(ws[i : i + width]), ())})
        spans = []
        for d in lines:
            if spans and d - spans[-1][-1] <= license_scan.NEAR:
                spans[-1].append(d)
            else:
                spans.append([d])
        for span in spans:
            share = sum(any(0 <= j + d < len(ws) and ws[j + d] == w for d in span) for j, w in enumerate(template)) / len(template)
            score = max(score, share)
            labels |= {label} if share >= license_scan.COVERED else set()
    return labels, score


def test_op10_labels_and_scores_by_hand(spark):
    random.seed(6)
    texts = [(d.doc_id, d.text) for d in table_rows(spark)]
    for k, text in enumerate(license_scan.TEXTS.values()):
        for n in range(5):
            ws = text.split()
            for i in sorted(random.sample(range(len(ws)), n * len(ws) // 20), reverse=True):
                ws[i : i + 1] = random.choice([["zzz"], [], ["zzz", ws[i]]])
            texts.append((-10 * k - n - 1, "Copyright me. " + " ".join(ws) + " end"))
    rows = license_scan.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()
    by_id = dict(texts)
    for r in rows:
        labels, score = spans_by_hand(by_id[r.doc_id])
        assert set(filter(None, r.labels.split(","))) == labels | set(filter(None, r.base_labels.split(","))) and r.score == pytest.approx(score), r.doc_id
    found = {r.doc_id: r.labels for r in rows}
    assert all(label in found[-10 * k - n - 1].split(",") for k, label in enumerate(license_scan.TEXTS) for n in range(2))


def test_neighbouring_diagonals_merge(spark):
    text = "permission is hereby truly granted free of charge"
    docs = spark.createDataFrame([(1, text, "a"), (1, text, "a"), (None, None, None)], "doc_id long, text string, labels string").withColumns({c: F.lit(1) for c in ("score", "n_words", "row", "mark", "spans")})
    rows = license_scan.scan_licenses(docs).collect()
    assert [r.labels for r in rows if r.doc_id] == ["mit", "mit"] and all(r.base_labels == "" and 0.8 <= r.score <= 1 for r in rows if r.doc_id)


def shuffled_bytes(spark, frame):
    """Bytes of all rows that a run of ``frame`` sends from task to task, before compression."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frame.collect()
        plans, total = [frame._jdf.queryExecution().executedPlan()], 0
        while plans:
            plan = plans.pop()
            plans += [plan.children().apply(k) for k in range(plan.children().size())]
            total += plan.metrics().apply("dataSize").value() if plan.nodeName() == "Exchange" else 0
        return total
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize(("phrase", "most"), [("", 0.05), ("Licensed under the Apache License, Version 2.0", 1.0)])
def test_op10_shuffles_no_texts(spark, tmp_path, phrase, most):
    texts = [f"{phrase} {n} " + "Wörter zwischen Himmel und Erde of no kind at all " * 50 for n in range(400)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sent = shuffled_bytes(spark, queries.op10_license_scan(spark, str(tmp_path)))
    assert 0 < sent < most * sum(len(t.encode()) for t in texts)


def test_op10_repeated_rows_and_broken_phrases(spark):
    texts = ["mit license", "general public general public license public license", "public license mit", "general public"]
    docs = [(k, t) for k, t in enumerate(texts) for _ in range(k + 1)] + [(None, "an mit license"), (None, "apache license"), (None, "none"), (None, None), (0, "apache")]
    rows = license_scan.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    got = [(r.doc_id, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows]
    assert sorted((g[1:] for g in got if g[0] is None), key=str) == [(0, None, None, ""), (0, None, None, ""), (1, 0, 0, "apache"), (1, 1, 1, "mit")]
    assert sorted((g for g in got if g[0] is not None), key=lambda g: (g[0], -g[1])) == [(0, 1, 0, 0, "mit"), (0, 0, None, None, ""), *[(1, 1, 2, 2, "gpl")] * 2, *[(2, 0, None, None, "")] * 3, *[(3, 0, None, None, "")] * 4]


def test_op10_numbers_tell_template_words_apart(spark):
    known = sorted({w for *_, ws in license_scan.templates() for w in ws})
    row = spark.createDataFrame([([*known, "zzz"],)], "ws array<string>").select(license_scan._numbers(F.col("ws")).alias("n")).first()
    assert row.n[-1] is None and None not in row.n[:-1] and len(set(row.n[:-1])) == len(known)


def test_shared_words(spark):
    texts = ["", "a", "--A b!", "É é ñ", "..", "x  y"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(shared.words(F.col("t")).alias("w")).collect()
    assert [r.w for r in rows] == [[], ["a"], ["a", "b"], ["É", "é", "ñ"], [], ["x", "y"]]
