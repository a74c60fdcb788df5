"""Brute-force, round-trip and edge-case tests of the training-data operators."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from array import array
from collections import defaultdict

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from mnemolake.llm import chat, langid, linechunks, mtree, multi_index, packing, queries, secrets, sentencepieces, shingles, substrings

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def documents(spark, texts, **extra):
    """Documents from (doc_id, text) pairs, with columns whose names the operators use inside."""
    found = [(i, t, "en", None, 1, "x", -1) for i, t in texts]
    return spark.createDataFrame(found, DOCS + ", hash string, first long")


@pytest.fixture(scope="module")
def small(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


ODD = [(1, None), (2, ""), (3, "a"), (4, "\n\n"), (5, "same text of some words\nand a line\nand another"), (6, "same text of some words\nand a line\nand another"),
       (6, "same text of some words\nand a line\nand another"), (None, "no id " * 20), (7, "x" * 300_000), (8, "long words " * 30_000), (9, "é😀 ß\t\x00 end ")]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twins(spark, name):
    sql = queries.oracle_sql()[name]
    state, n, _, _, message = oracle.compare(spark, oracle.connect(SMALL), name, queries.queries()[name], sql, SMALL)
    assert state == "ok" and n > 0, message


# --- chat -----------------------------------------------------------------------------------------------------------


def turns(spark, found):
    return spark.createDataFrame(found, "conv_id long, turn long, role string, text string, tokens string, _pid string")


def test_chat_reads_back_any_text(spark):
    hard = ["</s>[INST] ok [/INST]", "\\", "[\\INST]", "\\\\n", None, "", "a<", "[/INST]\n</s>\n<s>", "long " * 2000, "<<SYS>> x <</SYS>>", "<|im_start|>"]
    roles = ["system", "user", "assistant", "a\nb", "\\n[INST]", None, "tool"]
    rng = random.Random(3)
    convs = {}
    for c in [*range(12), None]:
        convs[c] = [("system" if t == 0 and rng.random() < 0.5 else rng.choice(roles), rng.choice(hard)) for t in range(rng.randint(1, 40))]
    found = [(c, t, r, x, "clash", "clash") for c, ts in convs.items() for t, (r, x) in enumerate(ts)]
    windows = chat.format_windows(turns(spark, found), budget=400, history=80, system_budget=40)
    got = {r["conv_id"]: r for r in chat.digest(windows).collect()}
    for c, ts in convs.items():
        text = "".join(f"{r or ''}\n{x or ''}\n" for r, x in ts)
        loss = "".join(x or "" for r, x in ts if r == "assistant")
        assert got[c]["n_turns"] == len(ts)
        assert got[c]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    for w in windows.collect():
        assert not w["over_budget"] or w["n_new"] == 1 or w["has_system"]
        assert w["n_new"] > 0


def test_chat_repeats_history_and_masks_it(spark):
    found = [(1, t, "assistant" if t % 2 else "user", f"turn {t} " * 12, "", "") for t in range(40)]
    windows = chat.format_windows(turns(spark, found), budget=400, history=100, system_budget=20).orderBy("first_turn").collect()
    assert len(windows) > 3 and all(w["n_repeated"] > 0 for w in windows[1:]) and windows[0]["n_repeated"] == 0
    assert sum(len(w["loss_spans"]) for w in windows) == 20
    assert all(w["tokens"] <= 400 for w in windows)


def test_chat_ties_and_empty(spark):
    assert chat.digest(chat.format_windows(turns(spark, []))).count() == 0
    tied = [(1, None, "user", "b", "", ""), (1, None, "user", "a", "", ""), (1, 0, "user", "a", "", ""), (1, 0, "user", "a", "", "")]
    got = chat.digest(chat.format_windows(turns(spark, tied))).collect()
    assert got[0]["n_turns"] == 4 and got[0]["turns_sha256"] == hashlib.sha256(b"user\na\nuser\nb\nuser\na\nuser\na\n").hexdigest()


# --- vectors --------------------------------------------------------------------------------------------------------


def vector_rows(spark, found):
    return spark.createDataFrame(found, "vec_id long, embedding array<double>, label int")


def odd_vectors():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8))
    x[40:80] = x[40]
    found = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    bad = [(1000, None, 0), (1020, [1.0] * 7 + [None], 0), (1040, [float("nan")] * 8, 0), (1060, [1.0] * 3, 0), (1080, [float("inf")] + [0.0] * 7, 0), (None, [1.0] * 8, 0), (1100, [0.0] * 8, 0), (1120, [], 0)]
    return found, bad


def test_multi_index_is_exact_with_a_full_radius_and_near_otherwise(spark):
    found, bad = odd_vectors()
    vectors = multi_index.finite_vectors(vector_rows(spark, found + bad), "vec_id", "embedding")
    asked = vectors.filter(multi_index.is_query())
    x = np.array([v for _, v, _ in found])
    want = {}
    for q in range(0, 300, 20):
        s = (x * x[q]).sum(axis=1)
        order = [int(i) for i in np.lexsort((np.arange(300), -s)) if i != q][:20]
        want[q] = [(i, float(s[i])) for i in order]
    got = defaultdict(list)
    for r in multi_index.nearest(vectors, asked, radius=8).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got == want
    held = total = 0
    for r in multi_index.nearest(vectors, asked).collect():
        held += r["vec_id"] in {i for i, _ in want[r["query_id"]]}
        total += 1
    assert total == 300 and held / total >= 0.9
    assert multi_index.nearest(vectors.limit(0), asked).count() == 0


def test_multi_index_probes_every_code_within_the_radius():
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 1 << 24, 2000, dtype=np.uint64)
    index = multi_index.MultiIndex(codes, 24)
    for radius in (0, 1, 2, 3, 5, 8, 24):
        for code in codes[:20]:
            assert index.within(code, radius).tolist() == np.flatnonzero(np.bitwise_count(codes ^ code) <= radius).tolist()


def test_mtree_is_exact(spark, monkeypatch):
    found, bad = odd_vectors()
    monkeypatch.setattr(mtree, "ROWS_PER_BLOCK", 64)
    big = [(1140, [1e300] + [0.0] * 7, 0)]
    vectors = mtree.integer_vectors(mtree.finite_vectors(vector_rows(spark, found + bad + big), "vec_id", "embedding"))
    x = np.floor(64 * np.array([v for _, v, _ in found])).astype(int)
    ids = np.append(np.arange(300), 1100)
    x = np.vstack([x, np.zeros((1, 8), int)])
    got = defaultdict(list)
    for r in mtree.top_scores(vectors, vectors.filter(mtree.is_query())).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == {*range(0, 300, 20), 1100}
    for q, hits in got.items():
        at = int(np.flatnonzero(ids == q)[0])
        s = x @ x[at]
        assert hits == [(int(ids[i]), int(s[i])) for i in np.lexsort((ids, -s)) if i != at][:20]
    assert mtree.top_scores(vectors.limit(0), vectors).count() == 0


def test_mtree_skips_distances():
    rng = np.random.default_rng(7)
    x = np.floor(rng.normal(size=(4000, 6)) * 4 + np.repeat(rng.integers(-300, 300, (40, 6)), 100, axis=0))
    tree = mtree.MTree(np.arange(4000), x, float((x * x).sum(axis=1).max()), page=32, fanout=8)
    for q in range(0, 4000, 200):
        ids, scores = tree.top(q, x[q], 5)
        s = (x @ x[q]).astype(int)
        assert ids.tolist() == [int(i) for i in np.lexsort((np.arange(4000), -s)) if i != q][:5]
    assert tree.computed < 20 * 4000 / 2


# --- substrings -----------------------------------------------------------------------------------------------------


def cut_brute(found):
    first = {}
    for i, t in found:
        if i is not None:
            b = (t or "").encode()
            for p in range(len(b) - 49):
                first[b[p : p + 50]] = min(first.get(b[p : p + 50], i), i)
    out = []
    for i, t in found:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 49) if i is not None else ():
            if first[b[p : p + 50]] < i:
                gone[p] += 1
                gone[p + 50 if p + 50 < len(gone) else len(b)] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        out.append((i, len(b), int(gone.sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=str)


def cut_rows(df):
    return sorted(((r["doc_id"], r["n_bytes"], sum(s["length"] for s in r["spans"]), bytes(r["kept"])) for r in df.collect()), key=str)


def test_substrings_against_brute_force(spark, small):
    rng = random.Random(4)
    near = [(1000 + i, t[: len(t) // 2] + "changed" + t[len(t) // 2 :]) for i, t in small[:40] if t]
    shifted = [(2000 + k, " ".join(rng.choice("ab") for _ in range(30)) + "passage " * 9 + "q" * k) for k in range(30)]
    texts = [t for t in small if len(t[1]) < 20_000] + near + shifted + [t for t in ODD if len(t[1] or "") < 1000]
    assert cut_rows(substrings.remove_repeats(documents(spark, texts))) == cut_brute(texts)


def test_a_chunk_is_read_alike_in_any_order(monkeypatch):
    import pyarrow as pa

    rng = random.Random(14)
    found = [(i, "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 90_000))).encode()) for i in range(12)] + [(None, b"x" * 80)]
    marks = []
    for _ in range(3):
        rng.shuffle(found)
        chunk = substrings.Chunk(pa.table({"doc_id": [i for i, _ in found], "body": [b for _, b in found]}), None, 5)
        marks.append((chunk.h.tobytes(), chunk.f.tobytes(), chunk.first_of.tobytes(), sorted((k, v.tobytes()) for k, v in chunk.by_bucket.items())))
    assert marks[0] == marks[1] == marks[2]


def test_substrings_long_and_empty(spark, monkeypatch):
    long = "".join(random.Random(5).choice("abcdefgh ") for _ in range(600_000))
    found = [(1, long), (2, "x" + long[1000:]), (3, None), (4, "")]
    got = {r["doc_id"]: r for r in substrings.remove_repeats(documents(spark, found)).collect()}
    assert not got[1]["spans"] and bytes(got[2]["kept"]) == b"x" and got[3]["n_bytes"] == 0 and bytes(got[4]["kept"]) == b""
    assert substrings.remove_repeats(documents(spark, [])).count() == 0


def test_deep_shallow_sort_is_a_suffix_sort():
    rng = random.Random(6)
    text = "".join(rng.choice("ab") for _ in range(400)) + "abcab" * 60 + "".join(rng.choice("ab") for _ in range(300))
    data = (text * 2).encode()
    starts = np.array([i for i in range(len(data) - 50)] + [3, 3, 9])
    for shallow in (0, 1, 4):
        order, group = substrings.sort_windows(data, starts, shallow)
        windows = [data[s : s + 50] for s in starts[order].tolist()]
        assert windows == sorted(windows)
        assert [a == b for a, b in zip(windows, windows[1:])] == (group[1:] == group[:-1]).tolist()


# --- shingles -------------------------------------------------------------------------------------------------------


def components_brute(found, width=4, percent=85):
    sets = []
    for i, t in found:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), (t or "") if i is not None else ""))
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    label = [i for i, _ in found]
    links = [
        (a, b) for a in range(len(sets)) for b in range(a)
        if sets[a] and sets[b] and label[a] is not None and label[b] is not None
        and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= (label[a], label[b]) != (low, low)
            label[a] = label[b] = low
    return sorted(((i, len(s), c) for (i, _), s, c in zip(found, sets, label)), key=str)


def near_copies(n=60, words=60, seed=8):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 500)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("cell", [1024, 4])
def test_jaccard_components_against_brute_force(spark, small, monkeypatch, cell):
    monkeypatch.setattr(shingles, "CELL_TEXTS", cell)
    texts = small[:80] + [(5000 + i, t) for i, t in enumerate(near_copies())] + [t for t in ODD if t[0] not in (7, 8)]
    got = rows(shingles.jaccard_components(documents(spark, texts)).select("doc_id", "n_shingles", "component_id"))
    assert got == components_brute(texts)
    got = rows(shingles.jaccard_components(documents(spark, texts), 5, 80).select("doc_id", "n_shingles", "component_id"))
    assert got == components_brute(texts, 5, 80)


def test_jaccard_empty_and_without_links(spark):
    assert shingles.jaccard_components(documents(spark, [])).count() == 0
    alone = [(1, "a b c d e f"), (2, "g h i j k l"), (3, None)]
    assert rows(shingles.jaccard_components(documents(spark, alone)).select("doc_id", "component_id")) == [(1, 1), (2, 2), (3, 3)]


def test_jaccard_copies_in_falling_order_of_ids(spark):
    texts = [(i, f"copy number {i % 3} of a text with some words") for i in range(40, 0, -1)]
    docs = documents(spark, texts).coalesce(1)
    assert rows(shingles.jaccard_components(docs).select("doc_id", "n_shingles", "component_id")) == components_brute(texts)


def test_links_in_fragments(monkeypatch):
    monkeypatch.setattr(shingles, "FRAGMENT_CELLS", 64)
    sets = shingles.gram_sets([t.encode() for t in near_copies(40)], 4)
    both = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    want = [[100 * k >= 85 * (len(a) + len(b) - k) for k, b in zip(line, sets)] for line, a in zip(both, sets)]
    # whether a set links with itself is left open
    own = shingles.links_in(sets, None, 85)
    assert (own | np.eye(len(sets), dtype=bool)).tolist() == want and own.sum() > 20
    assert shingles.links_in(sets[:7], sets[7:], 85).tolist() == [line[7:] for line in want[:7]]


# --- secrets --------------------------------------------------------------------------------------------------------


def test_guess_cost_takes_the_cheapest_segmentation():
    assert secrets.guess_cost("password")[0] < secrets.guess_cost("passwxrd")[0]
    assert [k for _, _, k in secrets.guess_cost("Summer2024")[1]] == ["word", "date"]
    assert [k for _, _, k in secrets.guess_cost("qwertyuiop")[1]] == ["walk"]
    assert [k for _, _, k in secrets.guess_cost("abcxabcxabcx")[1]] == ["repeat"]
    # against all segmentations of short values
    def every(value):
        unit = np.log10(secrets._alphabet(value))
        known = {(i, j): c for i, j, _, c in sorted(secrets.segments(value), key=lambda s: -s[3])}
        best = {(0, False): 0.0}
        for j in range(1, len(value) + 1):
            for brute in (True, False):
                options = []
                if brute:
                    for was in (True, False):
                        if (j - 1, was) in best:
                            options.append(best[j - 1, was] + unit + (0 if was else 0.3))
                else:
                    options += [best[i, was] + c + 0.3 for (i, e), c in known.items() if e == j for was in (True, False) if (i, was) in best]
                if options:
                    best[j, brute] = min(options)
        return min(v for (j, _), v in best.items() if j == len(value))
    for value in ("letmein99", "x9$Kd!", "aaa111bbb", "admin2020x", "zxcvbn12"):
        assert secrets.guess_cost(value)[0] <= every(value) + 0.31 and secrets.guess_cost(value)[0] >= every(value) - 1e-9


def test_secret_spans_and_redaction(spark):
    key = "AKIA" + "Q" * 16
    text = f"password = \"hunter2x9Zq!\" token:ab secret:token:abcdefgh\n{key} é {'0a' * 12} my password is Gk39xkQpWm22 and pwd=password1"
    base, spans = secrets.scan_text(text)
    kinds = [(k, text[a:b]) for k, a, b in spans]
    assert ("access", key) in kinds and ("hex", "0a" * 12) in kinds and ("guess", "Gk39xkQpWm22") in kinds
    assert not any(k == "guess" and t == "password1" for k, t in kinds)
    assert [k for k, _, _ in base].count("assign") == 1 and set(base) <= set(spans)
    docs = documents(spark, [(1, text), (2, None), (3, ""), (4, "clean text"), (4, "clean text")])
    out = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert key not in out[1] and "Gk39" not in out[1] and out[2] is None and out[3] == "" and out[4] == "clean text"
    assert secrets.redact(docs).columns == docs.columns and secrets.redact(docs).count() == 5
    found = {r["doc_id"]: r for r in secrets.scan_documents(docs).collect()}
    assert found[2]["spans"] == [] and [tuple(s) for s in found[1]["spans"]] == [tuple(s) for s in spans]
    assert secrets.scan_documents(documents(spark, [])).count() == 0


# --- tokenizers -----------------------------------------------------------------------------------------------------


def test_sentencepieces_equal_the_library(spark, small):
    import sentencepiece

    path = sentencepieces.default_model()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    own = sentencepieces.Codec(path)
    rng = random.Random(9)
    texts = ["", " ", "  a  b ", "\n", "▁x▁▁", "a\tb\x00", "😀👩‍👧 ß", "<s></s>", " " * 40 + "x", "aaaa" * 500] + [t for _, t in small[:60]]
    texts += ["".join(rng.choice("abcdeinst  \n▁.é日😀0123") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    for t in texts:
        want = library.encode(t, add_eos=True)
        got = own.encode(t)
        assert got == want and own.decode(got) == library.decode(want)
    bad = [3 + 0xE9, 3 + 0x41, 300, 3 + 0xFF]
    assert own.decode(bad) == library.decode(bad)
    out = {r["doc_id"]: r for r in sentencepieces.encode_documents(documents(spark, ODD)).collect()}
    assert out[1]["n_tokens"] == 1 and out[1]["ids_text"] == "2" and out[1]["decoded"] == ""
    assert out[8]["ids_text"] == " ".join(map(str, library.encode(ODD[9][1], add_eos=True)))
    assert sentencepieces.encode_documents(documents(spark, [])).count() == 0


def test_word_ids_equal_the_library(small):
    from tokenizers import Tokenizer

    path = packing.default_model()
    library, own = Tokenizer.from_file(path), packing.WordTokens(path)
    rng = random.Random(10)
    alphabet = list("abcdeinstΣσ  \n.,!é日😀0123'İ") + ["́", "\x1c", "\t", "　", "<|endoftext|>", "n't ", "it's", "ﬁ", "\r\n"]
    texts = [t for _, t in small[:80]] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for t in texts:
        assert array("I", own.encode(t)).tolist() == library.encode(t, add_special_tokens=False).ids


def test_tournament_tree_is_first_fit_decreasing():
    rng = random.Random(11)
    sizes = sorted((rng.randint(1, 100) for _ in range(500)), reverse=True)
    free, want = [], []
    for s in sizes:
        b = next((i for i, f in enumerate(free) if f >= s), None)
        if b is None:
            b = len(free)
            free.append(100)
        want.append((b, 100 - free[b]))
        free[b] -= s
    assert packing.first_fit_decreasing(sizes, 100) == want


def packed_well(out, capacity):
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in out:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return by_doc


def test_packing_edge_cases(spark):
    out = packing.pack_documents(documents(spark, ODD), capacity=512).collect()
    by_doc = packed_well(out, 512)
    assert {*by_doc} == {i for i, _ in ODD} and [r["ids"] for r in by_doc[1]] == [[2]] and len(by_doc[6]) == 2
    ids = [x for r in sorted(by_doc[8], key=lambda r: r["start"]) for x in r["ids"]]
    assert len(ids) == by_doc[8][0]["doc_tokens"] and ids[-1] == 2
    assert all(zlib.crc32(array("I", r["ids"]).tobytes()) == r["ids_crc32"] for r in out)
    assert packing.pack_documents(documents(spark, [])).count() == 0


# --- lines ----------------------------------------------------------------------------------------------------------


def lines_brute(found, window=2, least=2, spacing=4):
    turn = lambda h: ((h & ((1 << 59) - 1)) << 1) | (h >> 59)
    firsts, parts = {}, {}
    order = sorted({(i, t) for i, t in found if t is not None}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    for i, t in order:
        lines, begin, own = t.split("\n"), 0, []
        if len(lines) > 1:
            h = [int(hashlib.md5(x.encode()).hexdigest()[:15], 16) for x in lines]
            for k in range(len(lines)):
                r = h[k] ^ turn(h[k - 1]) if k else h[k]
                if r % spacing == 0 or k == len(lines) - 1:
                    own.append((begin, k + 1))
                    begin = k + 1
        parts[i, t] = [(a, b) for a, b in own if b - a >= least]
        for a, b in parts[i, t]:
            firsts.setdefault("\n".join(lines[a:b]), (i, t, a))
    out = []
    for i, t in found:
        lines = (t or "").split("\n")
        gone = {k for a, b in parts.get((i, t), ()) if firsts["\n".join(lines[a:b])] != (i, t, a) for k in range(a, b)}
        out.append((i, t if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)))
    return sorted(out, key=str)


def test_line_chunks_against_brute_force(spark, small):
    passage = "\n".join(f"line {k} of a passage" for k in range(30))
    texts = [(i, t) for i, t in small] + [(3000 + k, f"own {k}\n" * (k % 3) + passage + f"\nend {k}") for k in range(20)] + [t for t in ODD if t[0] != 7]
    texts += [(None, passage), (4000, passage + "\n" + passage)]
    docs = documents(spark, texts)
    out = linechunks.remove_line_chunks(docs, count_col="gone")
    assert out.columns == docs.columns + ["gone"]
    assert rows(out.select("doc_id", "text", "gone")) == lines_brute(texts)
    assert linechunks.remove_line_chunks(documents(spark, [])).count() == 0


def test_line_chunks_under_one_hash_are_told_apart_by_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(linechunks, "line_hash", lambda line: F.lit(1).cast("long"))
    texts = [(1, "a\nb"), (2, "c\nd"), (3, "a\nb"), (4, "e\nf")]
    got = {r["doc_id"]: r["text"] for r in linechunks.remove_line_chunks(documents(spark, texts)).collect()}
    assert got == {1: "a\nb", 2: "c\nd", 3: "", 4: "e\nf"}


def passages_brute(found):
    firsts, out = {}, []
    for i, t in sorted({(i, t) for i, t in found if t is not None}, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        lines = t.split("\n")
        for k, pair in enumerate(zip(lines, lines[1:])):
            firsts.setdefault(pair, (i, t, k))
    for i, t in found:
        lines, gone = (t or "").split("\n"), set()
        for k, pair in enumerate(zip(lines, lines[1:])):
            doc, text, at = firsts[pair]
            if (doc, text) != (i, t) or k >= at + 2:
                gone |= {k, k + 1}
        out.append((i, t if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)))
    return sorted(out, key=str)


def test_repeated_passages_go_inside_different_texts(spark, small):
    def text(name, passage):
        return "\n".join([f"{name} one", f"{name} two", *passage, f"{name} three", f"{name} four"])

    passages = [[f"passage {n} line {k}" for k in range(n)] for n in range(2, 9)]
    texts = [(10 * n + c, text(f"doc {n} {c}", p)) for n, p in enumerate(passages) for c in range(3)]
    got = {r["doc_id"]: (r["text"], r["gone"]) for r in linechunks.remove_repeated_passages(documents(spark, texts), count_col="gone").collect()}
    for n, p in enumerate(passages):
        assert got[10 * n] == (text(f"doc {n} 0", p), 0)
        assert all(got[10 * n + c] == (text(f"doc {n} {c}", []), len(p)) for c in (1, 2))
    odd = [t for t in ODD if t[0] != 7] + [(None, "a\nb\nc"), (30, "x\nx\nx"), (31, "y\ny\ny\ny\ny"), (32, "x\na\nb\na\nb\nc\nd"), (33, "c\nd\nx\nx")]
    docs = documents(spark, small + odd)
    out = linechunks.remove_repeated_passages(docs, count_col="gone")
    assert out.columns == docs.columns + ["gone"] and rows(out.select("doc_id", "text", "gone")) == passages_brute(small + odd)
    assert linechunks.remove_repeated_passages(documents(spark, [])).count() == 0


# --- languages ------------------------------------------------------------------------------------------------------


def test_forward_backward_is_exact():
    rng = np.random.default_rng(12)
    for lengths in ([1], [3, 200, 64, 65, 1, 128]):
        lengths = np.array(lengths)
        scores, trans, start = rng.normal(size=(lengths.sum(), 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
        got, at = langid.forward_backward(scores, lengths, trans, start), 0
        for n in lengths:
            s = scores[at : at + n]
            a = [np.exp(start + s[0])]
            for t in range(1, n):
                v = a[-1] @ np.exp(trans) * np.exp(s[t])
                a.append(v / v.sum())
            b = [np.ones(3)]
            for t in range(n - 2, -1, -1):
                v = np.exp(trans) @ (np.exp(s[t + 1]) * b[-1])
                b.append(v / v.sum())
            w = np.array(a) * np.array(b[::-1])
            assert np.allclose(w / w.sum(axis=1, keepdims=True), got[at : at + n])
            at += n


def test_language_id_on_held_out_documents_and_edge_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(docs.select("doc_id", "text", "lang").filter(~langid.held_out()))
    held = docs.filter(langid.held_out())
    found = langid.identify(held, model, ("doc_id", "lang")).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.97 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)
    odd = {r["doc_id"]: r for r in langid.identify(documents(spark, [*ODD, (20, "123 !!")]), model).collect()}
    assert odd[1]["lang_pred"] == odd[2]["lang_pred"] == odd[20]["lang_pred"] == "und" and odd[8]["lang_pred"] in model.labels
    assert langid.identify(documents(spark, []), model).count() == 0
    unlabelled = docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))
    assert langid.learn(unlabelled) is None
    assert {r["lang_pred"] for r in langid.identify(held.limit(3), None).collect()} == {"und"}


def test_long_runs_of_letters_are_read_to_the_end(spark):
    assert langid.words_of("a" * 50 + " b") == ["a" * 24, "a" * 24, "aa", "b"]
    rng = random.Random(13)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    letters = {"aa": "abcdefgh", "zz": "stuvwxyz"}
    found = [(k, " ".join(word(letters[lang], rng.randint(2, 24)) for _ in range(40)), lang) for k, lang in enumerate(["aa", "zz"] * 20)]
    model = langid.learn(spark.createDataFrame(found, "doc_id long, text string, lang string"))
    text = word(letters["aa"], 24) + word(letters["zz"], 400)
    assert [lang for lang, _ in langid.predict_texts(model, [text])] == ["zz"]


def test_words_of_two_languages_are_labelled_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(docs.select("doc_id", "text", "lang").filter(~langid.held_out()))
    text = {r["lang"]: langid.words_of(r["text"])[:60] for r in docs.filter(langid.held_out() & (F.length("text") > 600)).collect()}
    words = text["de"] + text["fr"]
    p = langid.forward_backward(model.emissions(words), np.array([len(words)]), model.trans, model.start)
    said = [model.labels[i] for i in p.argmax(axis=1)]
    assert said[:60].count("de") >= 54 and said[60:].count("fr") >= 54


# --- pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model = langid.learn(docs.select("doc_id", "text", "lang").filter(~langid.held_out()))
    said = langid.predict_texts(model, [t for _, t in found])
    found = [d for d, (lang, score) in zip(found, said) if lang != "und" and score >= corpus_pipeline.LEAST_LANG_SCORE]
    found = [(i, t) for i, t, gone in passages_brute(found) if not gone or t.strip(" ")]
    found = [(i, t) for (i, t), (j, n, c) in zip(sorted(found, key=str), sorted(components_brute(sorted(found, key=str), 5, 80), key=str)) if n == 0 or i == c]
    tokenizer, want = Tokenizer.from_file(packing.default_model()), []
    for i, t in found:
        out, end = [], 0
        for _, a, b in secrets.scan_text(t)[1]:
            if b > end:
                out += [t[end:a], "[SECRET]"] if a >= end else []
                end = b
        ids = tokenizer.encode("".join(out) + t[end:], add_special_tokens=False).ids + [2]
        for start in range(0, len(ids), 4096):
            piece = ids[start : start + 4096]
            want.append((i, start, len(piece), zlib.crc32(array("I", piece).tobytes()), len(ids)))
    got = corpus_pipeline.run(spark, SMALL).collect()
    packed_well(got, 4096)
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == sorted(want)


def test_pipeline_stages_keep_columns_and_survive_odd_rows(spark, tmp_path):
    import corpus_pipeline

    assert os.path.isfile(f"{SMALL}/documents.parquet")
    given = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("hash", F.lit("x")).withColumn("first", F.lit(0).cast("long"))
    docs = given.unionByName(documents(spark, ODD))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    assert docs.count() > 0
    empty = documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0, name
