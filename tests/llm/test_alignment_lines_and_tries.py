import hashlib
import random
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from normloom.llm import line_dedup, prefix_trie, queries, token_align

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  two  spaces ", "\n \n  x", "a\t b", "a<|endoftext|>b <s> </s>", "漢字かな交じり 文😀👩‍👧", "▁ no", "x" * 3000, " " * 700 + "y", "é" * 500 + " " + "ab1234567 " * 50, "\x00\x1f \x1f  z", "don't  I'll\r\n\r\n  end    q"]


def encoded(text, a, b):
    """Ids and byte ends of both sides by the libraries, whole texts at once."""
    if not text:
        return None
    whole, symbols = (" " + text).encode(), token_align._byte_symbols()
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    spelt = [bytes(symbols[c] for c in a.id_to_token(i)) for i in ids[0]], []
    for i in ids[1]:
        name = b.id_to_piece(i)
        spelt[1].append(bytes([int(name[3:5], 16)]) if b.is_byte(i) else name.replace("▁", " ").encode())
    if any(b"".join(s) != whole for s in spelt):
        return None
    return [(i, np.cumsum([len(t) for t in s]).tolist()) for i, s in zip(ids, spelt, strict=True)]


def aligned_by_hand(texts):
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    docs, held = [], Counter()
    for text in texts:
        both, groups = encoded(text, a, b), []
        if both:
            cuts = sorted(set(both[0][1]) & set(both[1][1]))
            groups = [[[], []] for _ in cuts]
            for s, (ids, ends) in enumerate(both):
                for i, e in zip(ids, ends, strict=True):
                    groups[bisect_left(cuts, e)][s].append(i)
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        held.update(links.keys())
        docs.append((both, groups, links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for both, groups, links in docs:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(both[0][0]) if both else 0, len(both[1][0]) if both else 0, len(groups), sum(links.values()), sum(n for k, n in links.items() if held[k] == best[k[0]]), sum(n * held[k] for k, n in links.items()), hashlib.sha256(said.encode()).hexdigest() if both else ""))
    return out


def test_op11_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: w for d, w in zip(docs, aligned_by_hand([d.text for d in docs]), strict=True)}
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in queries.op11_token_align(spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("broadcast_rows", [0, 10**6])
def test_alignment_of_odd_texts_in_small_blocks(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(token_align, "BLOCK", 7)
    monkeypatch.setattr(token_align, "WIDE", 3)
    texts = ODD + ODD[4:9] + ["漢字かな交じり 文 " * 40]
    docs = spark.createDataFrame([(i if i % 5 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pair string").repartition(3)
    aligner = token_align.Aligner(spark, A, B)
    rows = aligner.align(docs, broadcast_rows=broadcast_rows).collect()
    got = sorted(((r.doc_id or 0), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows)
    assert got == sorted((i if i % 5 else 0, *w) for i, w in enumerate(aligned_by_hand(texts)))
    assert aligner.align(docs.limit(0)).count() == 0


def test_pieces_join_to_the_text_and_cut_no_token():
    for t in filter(None, ODD):
        assert "".join(token_align.pieces_of(t)) == " " + t
    made = token_align.Encoder(A, B)
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    random.seed(5)
    texts = ["".join(random.choice("ab é.\n\t 1漢") for _ in range(random.randrange(1, 60))) for _ in range(400)] + [t for t in ODD if t]
    for text, (x, y) in zip(texts, made.encode(texts), strict=True):
        both = encoded(text, a, b)
        assert [x.tolist(), y.tolist()] == ([both[0][0], both[1][0]] if both else [[], []])


def test_a_sweep_of_wide_groups_and_blocks_of_any_size():
    random.seed(9)
    lengths = np.array([1, 2, 3, 5, 7], np.int64)
    a = [random.randrange(5) for _ in range(400)]
    total, b = int(lengths[a].sum()), []
    while (left := total - int(lengths[b].sum())) > 0:
        b.append(random.choice([i for i in range(5) if lengths[i] <= left]))
    found = set()
    for size in (1, 3, 50, 1000):
        sweep, events = token_align.Sweep(token_align._marks(8)), []
        for side, ids in enumerate((a, b)):
            events += [(int(lengths[ids[:i]].sum()), side, ids[i : i + size]) for i in range(0, len(ids), size)]
        for start, side, ids in sorted(events):
            sweep.take(side, start, np.array(ids, np.uint16), lengths)
        found.add(sweep.row())
    assert len(found) == 1


def dropped_by_hand(docs, least=3, chars=20):
    lines = [(i, (t or "").split("\n")) for i, t in docs]
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, ls in lines:
        for x in ls:
            held[key(x)].add(i)
    stay = {k: max(ids, key=lambda i: (i is not None, i)) for k, ids in held.items() if len(k) >= chars and len(ids) >= least}
    out = []
    for i, ls in lines:
        kept = [x for x in ls if stay.get(key(x), i) == i]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


LONG, OTHER = "The same line in many documents ", " tHE SAME LINE IN MANY DOCUMENTS\r"
LINES = [(1, LONG + "\nown\n" + LONG), (2, OTHER), (2, "x\n" + OTHER), (3, "y\n" + LONG + "\n\n"), (None, OTHER + "\n" + "é" * 20), (5, "é" * 20 + "\n" + LONG), (6, "\t" + "é" * 20 + "\nÉ" + "é" * 19), (7, None), (8, ""), (9, "short\n" * 3000 + LONG), (10, "short")]


@pytest.mark.parametrize("most", [0, 1 << 25])
def test_lines_go_and_come_back(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", most)
    frame = lambda rows: spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, hi int, KEPT_TEXT string")
    kept = lambda index, rows: sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in index.kept(frame(rows)).collect()), key=str)
    index = line_dedup.LineIndex(spark, str(tmp_path / "index"), shards=3)
    assert kept(index, LINES) == sorted([(i, len((t or "").split("\n")), 0, t or "") for i, t in LINES], key=str)
    index.insert(frame(LINES[:4]))
    index.delete(frame([(77, "")]))
    index.insert(frame(LINES[4:]))
    assert kept(index, LINES) == dropped_by_hand(LINES)
    index.delete(frame([(9, ""), (None, "")]))
    left = [x for x in LINES if x[0] not in (9, None)]
    assert kept(line_dedup.LineIndex(spark, str(tmp_path / "index"), shards=3), left) == dropped_by_hand(left)
    index.delete(frame([(3, ""), (5, "")]))
    left = [x for x in left if x[0] not in (3, 5)]
    assert kept(index, left) == dropped_by_hand(left) and index.counts().isEmpty()
    index.insert(frame([x for x in LINES if x[0] in (3, 5, 9, None)]))
    assert kept(index, LINES) == dropped_by_hand(LINES)
    assert index.kept(frame(LINES).limit(0)).count() == 0 and [c for c in index.kept(frame(LINES)).columns if c.lower() == "kept_text"] == ["kept_text"]


def test_cuckoo_filter_against_a_set():
    random.seed(2)
    draw = np.random.default_rng(4)
    keys = draw.integers(-(2**63), 2**63 - 1, 20_000)
    made = line_dedup.Cuckoo.built(keys[:12_000])
    held = set(keys[:12_000].tolist())
    for _ in range(20):
        some = np.array(random.sample(sorted(held), 400))
        made.delete(some)
        held -= set(some.tolist())
        fresh = np.array([k for k in random.sample(keys.tolist(), 400) if k not in held])
        assert made.insert(fresh)
        held |= set(fresh.tolist())
        assert made.contains(np.array(sorted(held))).all()
    away = np.array([k for k in keys.tolist() if k not in held])
    assert made.contains(away).mean() < 0.005
    assert np.count_nonzero(made.slots) == len(held)
    assert not line_dedup.Cuckoo.sized(10).insert(keys[:500])


def test_a_full_filter_is_built_anew(spark, tmp_path):
    index = line_dedup.LineIndex(spark, str(tmp_path / "index"), least_docs=1, shards=1)
    frame = lambda some: spark.createDataFrame([(i, f"a line of twenty letters and number {i}") for i in some], "doc_id long, text string")
    index.insert(frame(range(5)))
    index.insert(frame(range(5, 400)))
    assert index.counts().count() == 400


def test_op12_by_hand(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.op12_line_dedup(spark, SF).collect()), key=str)
    assert got == sorted(((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in dropped_by_hand(docs)), key=str)


def trie_by_hand(turns, ids, rebuilt=True):
    own = {c: [(r or "", t or "") for _, r, t in sorted(((-1 if n is None else n, r or "", t or "") for i, n, r, t in turns if i == c))] for c in ids}
    told = {}
    for c in ids:
        h = zlib.crc32(str(c).encode()) % 4 if rebuilt else 0
        told[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:]) if rebuilt else tuple(own[c])
    members = defaultdict(list)
    for c, said in told.items():
        for d in range(len(said) + 1):
            members[said[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(members[p]) - 1) * len([w for w in p[-1][1].translate(str.maketrans("\t\n\x0b\x0c\r", " " * 5)).split(" ") if w]) if p else 0
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(told[c]) == len(p)).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], ends(p)) for p, m in members.items()), key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows_of(nodes):
    return sorted((tuple(r[c] for c in COLUMNS) for r in nodes.collect()), key=str)


def test_op13_by_hand(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.op13_prefix_trie(spark, SF)) == trie_by_hand(turns, {t[0] for t in turns})


@pytest.mark.parametrize(("heavy", "shard_nodes", "block"), [(4096, 2048, 1 << 16), (2, 3, 2), (0, 5, 1)])
def test_tries_of_odd_conversations(spark, monkeypatch, heavy, shard_nodes, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    random.seed(heavy)
    turns = [(c, n if n != 2 else None, random.choice(["user", None, ""]), random.choice(["a b", "", None, "c", " d\te "])) for c in range(30) for n in range(random.randrange(6))]
    turns += [(c, n, "user", "the same") for c in range(40, 61) for n in range(3)] + [(61, n, "user", "w" * 50 if n else "the same") for n in range(300)] + [(None, 1, "user", "x"), (-7, 0, "user", "a b"), (-7, 0, "user", "a b")]
    frame = spark.createDataFrame([(*t, "n") for t in turns], "conv_id long, turn long, role string, text string, depth string").repartition(3)
    ids = {t[0] for t in turns if t[0] is not None}
    laid = prefix_trie.ordered(frame)
    assert rows_of(prefix_trie.PrefixTrie(laid, frame, heavy, shard_nodes).nodes()) == trie_by_hand(turns, ids, rebuilt=False)
    # Conversations 0 to 61 with heads of others, -7 and a turnless one by the rule of the query.
    kept = {c for c in ids if c >= 0}
    some = frame.where("conv_id >= 0")
    trie = prefix_trie.PrefixTrie(prefix_trie.shared_heads(prefix_trie.ordered(some)), some, heavy, shard_nodes)
    assert rows_of(trie.nodes()) == trie_by_hand([t for t in turns if t[0] in kept], kept)
    stored = trie.shards().collect()
    assert sum(r.n_nodes for r in stored) == trie.nodes().count()
    assert all(np.unpackbits(np.frombuffer(r.louds, np.uint8), bitorder="little").sum() == r.n_nodes and len(r.labels) == 16 * r.n_nodes for r in stored)
    assert prefix_trie.PrefixTrie(prefix_trie.ordered(frame.limit(0)), frame.limit(0)).nodes().count() == 0


def test_a_turnless_trie_is_a_root(spark):
    frame = spark.createDataFrame([(4, None, None, None)], "conv_id long, turn long, role string, text string")
    root = prefix_trie.PrefixTrie(prefix_trie.ordered(frame).where(F.lit(False)), frame).nodes().collect()
    assert [tuple(r[c] for c in COLUMNS) for r in root] == [(4, 0, None, 1, 0, 1, 0, hashlib.sha256(b"4").hexdigest())]
