"""The operators against brute force on small rows: nulls, empty and long texts, ties, repeats, no rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tailrace.llm import bpe, chat, knn, licenses, linededup, mixing, quality, registry, simhash, substring

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return [w.decode() for w in WORD.findall((text or "").encode())]


def made_up(n, seed=0, vocabulary=12, longest=80):
    r = random.Random(seed)
    names = [f"w{i}é" for i in range(vocabulary)]
    out = [" ".join(r.choices(names, k=r.randint(0, longest))) for _ in range(n)]
    for i in range(3, n, 3):  # copied passages
        a = words(out[r.randrange(i)])
        at = r.randint(0, max(0, len(a) - 20))
        out[i] += " " + "  ".join(a[at : at + r.randint(5, 30)]) + "\tend"
    return out


# ---------------------------------------------------------------- 1 chat


def test_chat_round_trip(spark):
    control = "</s>[INST] ok [/INST]"
    turns = [
        (1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"),
        (2, 0, "system", "be brief"), (2, 1, "user", "hi"), (2, 2, "assistant", "<|im_end|>\n<\\</s>"), (2, 3, "user", None),
        (3, 0, "system", "be brief"), (3, 1, "user", "hi"), (3, 2, "assistant", "hello"),
        (4, 0, "user", control), (4, 1, "assistant", control + "<|im_start|>assistant<|im_sep|>x<|im_end|>"),
        (5, 1, None, "b"), (5, 1, "user", "a"), (5, None, "assistant", ""), (None, 0, "assistant", "long " * 5000),
    ]
    c = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS pack", "2 AS nodes")
    members, packs = chat.chat_format(c)
    got = {r.conv_id: r for r in members.join(chat.read_back(packs), "conversation").collect()}
    want = defaultdict(list)
    for i, t, r, x in sorted(turns, key=lambda t: (t[0] or 0, t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        want[i].append((r or "", x or ""))
    assert set(got) == set(want)
    for i, ts in want.items():
        loss = "".join(x for r, x in ts if r == "assistant")
        assert (got[i].n_turns, got[i].loss_chars) == (len(ts), len(loss))
        assert got[i].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in ts).encode()).hexdigest()
        assert got[i].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("most", [1, 60, 1 << 18])
def test_chat_tree_shares_and_attends(spark, most):
    """Each node of the tree of all conversations is written once, whatever the packs and partitions;
    positions and attention are those of its path."""
    r = random.Random(7)
    tries = [["a", "b", "c"], ["a", "b", "d"], ["a", "e"], ["a", "b", "c"], ["f"], ["a"], *([r.choice("ab") for _ in range(r.randint(1, 6))] for _ in range(60))]
    turns = [(i, t, "user" if t % 2 == 0 else "assistant", x) for i, xs in enumerate(tries) for t, x in enumerate(xs)]
    members, packs = chat.chat_format(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3), most)
    rows = packs.collect()
    assert sum(len(x.nodes) for x in rows) == len({tuple(xs[: d + 1]) for xs in tries for d in range(len(xs))})
    text_of = {n.id: x.text[n.start : n.end] for x in rows for n in x.nodes}
    assert len(text_of) == sum(len(x.nodes) for x in rows) and (most > 60 or any(x.above for x in rows))
    for x in rows:
        for n in x.nodes:
            path, at = [], n.parent
            while at >= 0:
                path.append(x.nodes[at])
                at = x.nodes[at].parent
            first = [text_of[i] for i in x.above[: n.above]]
            assert n.depth == len(first) + len(path) and n.position == sum(map(len, first)) + sum(p.end - p.start for p in path)
            assert {i for a in n.attention for i in range(a.start, a.end)} == {i for p in path for i in range(p.start, p.end)}
    got = {x.conv_id: x for x in members.join(chat.read_back(packs), "conversation").collect()}
    for i, xs in enumerate(tries):
        assert got[i].turns_sha256 == hashlib.sha256("".join(f"{'user' if t % 2 == 0 else 'assistant'}\n{x}\n" for t, x in enumerate(xs)).encode()).hexdigest()
        assert got[i].loss_sha256 == hashlib.sha256("".join(xs[1::2]).encode()).hexdigest()


def test_chat_escape_is_reversible():
    r = random.Random(1)
    parts = [*chat.CONTROL, "\\", "<", "[", "|", "x", "\n", "<\\", "im_start|>"]
    for _ in range(3000):
        t = "".join(r.choices(parts, k=r.randint(0, 8)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROL)


def test_chat_no_rows(spark):
    members, packs = chat.chat_format(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert members.count() == 0 and packs.count() == 0


# ---------------------------------------------------------------- 2 substring dedup


def brute_substring(rows, k):
    first = {}
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - k + 1):
            g = tuple(w[j : j + k])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = {j + d for j in range(len(w) - k + 1) if i is not None and first[tuple(w[j : j + k])] < i for d in range(k)}
        out.append((i, len(w), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,vocabulary", [(1, 3), (2, 12), (3, 60)])
def test_substring(docs, seed, vocabulary):
    texts = made_up(40, seed, vocabulary)
    rows = [(i * 7 % 41, t) for i, t in enumerate(texts)] + [(3, texts[5]), (None, texts[6]), (99, None), (98, ""), (97, " ".join(["same"] * 400)), (96, " ".join(["same"] * 300))]
    got = substring.substring_dedup(docs(rows)).collect()
    assert sorted(((r.doc_id, r.n_words, r.kept) for r in got), key=repr) == brute_substring(rows, 13)
    assert all(r.n_words == len(words(r.kept)) + sum(s.n for s in r.spans) for r in got)
    assert substring.substring_dedup(docs([(1, "x")]).limit(0)).count() == 0


def test_substring_compares_words(docs):
    """Words that sums of powers confuse are told apart."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    rest = " ".join(f"x{i}" for i in range(12))
    rows = [(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{rest} {a}"), (4, f"{a} {rest}")]
    got = sorted((r.doc_id, r.n_words, r.kept) for r in substring.substring_dedup(docs(rows)).collect())
    assert got == brute_substring(rows, 13) and got[1][2] == rows[1][1] and got[3][2] == ""


@pytest.mark.parametrize("window,gram", [(4, 5), (68, 5), (3, 0)])
def test_substring_refuses_windows_it_cannot_hold(docs, window, gram):
    with pytest.raises(ValueError):
        substring.substring_dedup(docs([(1, "x")]), window, gram)


def test_automaton_matches_by_shards():
    r = random.Random(5)
    found = [([r.randrange(3) for _ in range(r.randint(4, 25))], d) for d in range(30)]
    want = []
    for w, _ in found:
        want.append([min(d for x, d in found if any(x[i : i + 4] == w[j : j + 4] for i in range(len(x) - 3))) for j in range(len(w) - 3)])
    for shard in (10**6, 60, 1):
        assert substring.smallest(found, 4, shard) == want


def test_word_hashes_over_stretches(monkeypatch):
    text = " ".join(made_up(20, 9)).encode() + b" " + b"x" * 300
    whole = substring.word_hashes(text)
    monkeypatch.setattr(substring, "STRETCH", 50)
    assert (substring.word_hashes(text) == whole).all() and len(whole) == len(text.split())


# ---------------------------------------------------------------- 3 mixing


def test_mix(docs):
    r = random.Random(2)
    rows = [(i, " ".join("x" * r.randint(0, 30)), r.choice(["a", "b", "c", "d", None])) for i in range(300)] + [(7, "x y", "a"), (None, "x y z", "b"), (500, None, "c"), (501, " ", "e")]
    got = mixing.mix(docs(rows), range_rows=20).collect()
    assert len(got) == len(rows)
    size, source = Counter(), {}
    for i, t, s in rows:
        size[s] += len(words(t))
    total = sum(size.values())
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    rest = float(total)
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * size[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 3.0 * size[s]
            rest -= target[s]
        open_ -= over
    by = defaultdict(int)
    ids = {(i, len(words(t))): s for i, t, s in rows}
    for x in got:
        s = ids[(x.doc_id, x.size)]
        assert x.source_size == size[s] and x.target == pytest.approx(target[s]) and 0 <= x.taken <= 3 * x.size
        by[s] += x.taken
    assert all(abs(by[s] - target[s]) <= 1 for s in by)
    again = mixing.mix(docs(rows[::-1]), range_rows=7).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(docs(rows).limit(0)).count() == 0
    assert mixing.repeated(docs(rows[:100])).columns == docs(rows[:1]).columns


# ---------------------------------------------------------------- 4 BPE


def test_bpe_equals_library(docs):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    r = random.Random(3)
    parts = ["a", "the", "ing", " ", "\n", "\x1c", "\x85", " ", "Σ", "ß", "İ", "é", "é", "中", "🙂", "½", "12", "<|endoftext|>", "<|", "'s", "!?", "Ünïcode", "hello", "o"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 15))) for _ in range(800)] + ["", None, "aab" * 3000, "a" * 500]
    got = {x.doc_id: x for x in bpe.decode(bpe.encode(docs(list(enumerate(texts))), path), path).collect()}
    digest = {x.doc_id: x for x in bpe.digests(docs(list(enumerate(texts))), path).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (got[i].ids, got[i].decoded) == (ids, text), t
        assert digest[i].n_tokens == len(ids) and digest[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and digest[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(docs([(1, "a")]).limit(0), path).count() == 0


# ---------------------------------------------------------------- 5 SimHash


def brute_components(fps, ids):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(fps))]


def test_simhash(docs):
    texts = made_up(60, 4, 40, 120)
    r = random.Random(4)
    for i in range(40):  # near copies
        w = words(texts[i % 7])
        for _ in range(r.randint(0, 2)):
            if w:
                w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    rows = list(enumerate(texts)) + [(200, ""), (201, None), (202, "a b"), (None, texts[0]), (0, texts[0])]
    got = simhash.simhash_components(docs(rows)).collect()
    fps = [simhash.fingerprint(t) for _, t in rows]
    want = Counter((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, brute_components(fps, [i for i, _ in rows]), strict=True))
    assert Counter((x.doc_id, x.fingerprint, x.component_id) for x in got) == want
    assert simhash.simhash_components(docs(rows).limit(0)).count() == 0
    kept = simhash.keep_one(docs(rows)).collect()
    assert sorted(x.doc_id for x in kept if x.doc_id is not None) == sorted({c for _, _, c in want})


def test_simhash_files_filed_again(spark):
    """Whatever the size from which files are filed again, the classes are the same."""
    r = np.random.default_rng(5)
    seeds = r.integers(0, 1 << 63, 6, dtype=np.uint64)
    fp = seeds[r.integers(0, 6, 500)]
    for _ in range(3):
        fp ^= np.uint64(1) << r.integers(0, 64, 500).astype(np.uint64)
    fp = np.unique(fp)
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    want = brute_components([int(x) for x in fp], list(range(len(fp))))
    at = {int(x): i for i, x in enumerate(fp.view(np.int64))}
    for most in (10**6, 20, 0):
        label = list(range(len(fp)))

        def find(x):
            while label[x] != x:  # noqa: B023
                x = label[x]  # noqa: B023
            return x

        for a, b in simhash.links(df, most=most).collect():
            assert bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 4
            i, j = find(at[a]), find(at[b])
            label[max(i, j)] = min(i, j)
        assert [find(i) for i in range(len(fp))] == want


def test_simhash_large_files():
    r = np.random.default_rng(0)
    fp = np.unique(np.r_[r.integers(0, 1 << 63, 50, dtype=np.uint64), np.uint64(1 << 40) ^ (np.uint64(1) << r.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 300).astype(np.uint64))])
    a, b = simhash.linked(np.zeros(len(fp), dtype=np.int64), fp)
    assert len(a) < len(fp)
    at = {int(x): i for i, x in enumerate(fp)}
    label = list(range(len(fp)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for x, y in zip(a, b, strict=True):
        assert bin(int(x) ^ int(y)).count("1") <= 4
        label[find(at[int(x)])] = find(at[int(y)])
    assert len({find(i) for i in range(len(fp))}) == len(set(brute_components([int(x) for x in fp], range(len(fp)))))


# ---------------------------------------------------------------- 6 line dedup


def brute_lines_of(rows):
    """(lines, removed, kept) of each row, in order."""

    def units(lines):
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        ends = [i + 1 for i in range(len(lines)) if i == len(lines) - 1 or ((h[i - 1] if i else 0) % 2147483647 * 1000003 + h[i]) % 2147483647 % 4 < 3]
        chunks = list(zip([0, *ends[:-1]], ends, strict=True))
        spans = chunks + [(a, d) for (a, _), (_, d) in zip(chunks, chunks[1:], strict=False)]
        return sorted((a, b, t) for a, b in spans if b - a >= 2 and WORD.search((t := "\n".join(lines[a:b])).encode()))

    last = float("inf")
    first, found = {}, [((t or "").split("\n"), units((t or "").split("\n"))) for _, t in rows]
    for (i, _), (_, us) in zip(rows, found, strict=True):
        for _, _, t in us:
            first[t] = min(first.get(t, last), last if i is None else i)
    out = []
    for (i, _), (lines, us) in zip(rows, found, strict=True):
        gone, begin = set(), {}
        for a, b, t in us:
            begin.setdefault(t, a)
            if first[t] != (last if i is None else i) or a - begin[t] >= b - a:
                gone |= set(range(a, b))
        out.append((len(lines), len(gone), "\n".join(x for j, x in enumerate(lines) if j not in gone)))
    return out


def brute_lines(rows):
    return sorted(((i, *x) for (i, _), x in zip(rows, brute_lines_of(rows), strict=True)), key=repr)


def test_line_dedup(docs):
    r = random.Random(6)
    names = [f"line {i}" for i in range(30)] + ["", " "]
    base = ["\n".join(r.choices(names, k=r.randint(1, 30))) for _ in range(30)]
    rows = [(i, t if i % 3 else t + "\n" + base[i // 2]) for i, t in enumerate(base)] + [(40, base[0]), (40, base[1] + "\n" + base[1]), (None, base[2]), (41, None), (42, ""), (43, "\n\n\n")]
    got = linededup.line_dedup(docs(rows)).collect()
    assert sorted(((x.doc_id, x.n_lines, x.n_removed, x.kept) for x in got), key=repr) == brute_lines(rows)
    assert any(x.n_removed for x in got)
    long = [(50, "\n".join(f"{i % 700} of the lines" for i in range(4000))), (51, "\n".join(["one line"] * 300)), (52, None)]
    got = linededup.line_dedup(docs(long)).collect()
    assert sorted(((x.doc_id, x.n_lines, x.n_removed, x.kept) for x in got), key=repr) == brute_lines(long)
    assert linededup.line_dedup(docs(rows).limit(0)).count() == 0
    left = linededup.without_repeats(docs(rows))
    assert left.columns == docs(rows).columns and all(x.n_chars == len(x.text) for x in left.collect())


def test_line_dedup_deals_a_common_chunk_out(docs, monkeypatch):
    monkeypatch.setattr(linededup, "PLACES", 3)
    shared = "\n".join(f"shared {i}" for i in range(12))
    rows = [(i, f"own {i}\n{shared}\nend {i}") for i in range(-20, 40)] + [(7, shared), (8, f"{shared}\n{shared}")]
    got = linededup.line_dedup(docs(rows)).collect()
    assert sorted(((x.doc_id, x.n_lines, x.n_removed, x.kept) for x in got), key=repr) == brute_lines(rows)


# ---------------------------------------------------------------- 8 nearest vectors


def test_top_k(spark):
    r = np.random.default_rng(8)
    v = r.normal(size=(700, 6)).astype(np.float32)
    v[200:260] = v[0]  # one very common vector
    rows = [(int(i), [float(x) for x in v[i]]) for i in range(700)]
    rows += [(1000, None), (1050, [None, 1.0]), (1100, [float("nan")] * 6), (1150, [float("inf")] * 6), (None, [1.0] * 6), (1200, [2.0, -3.0]), (1250, [1e9] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS v", "3 AS rank")
    good = [(i, np.floor(np.r_[e, [0.0] * (6 - len(e))] * 256).astype(np.int64)) for i, e in rows[:700]] + [(1200, np.r_[512, -768, 0, 0, 0, 0]), (1250, np.full(6, 256 * 10**9))]
    want = {}
    for i, q in good:
        if i % 50 == 0:
            ranked = sorted(((-int(q @ x), j) for j, x in good if j != i))[:5]
            want |= {(i, n + 1): (j, -s) for n, (s, j) in enumerate(ranked)}
    got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in knn.top_k(df).collect()}
    assert got == want
    assert knn.top_k(df.limit(0)).count() == 0 and knn.top_k(df.where("vec_id = 50")).count() == 0
    few = knn.top_k(df.where("vec_id IN (50, 51, 52)")).collect()
    assert [(x["rank"]) for x in few] == [1, 2]


def brute_top_k(rows, k=5):
    got = []
    for n, (i, q) in enumerate(rows):
        if i % 50 == 0:
            ranked = sorted((-int(np.floor(np.array(q) * 256).astype(int) @ np.floor(np.array(x) * 256).astype(int)), j) for m, (j, x) in enumerate(rows) if m != n)[:k]
            got += [(i, r + 1, j, -s) for r, (s, j) in enumerate(ranked)]
    return sorted(got)


def test_top_k_rows_that_share_an_id(spark):
    rows = [(0, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [5.0, 0.0]), (4, [0.5, 0.0]), (0, [1.0, 0.0]), (0, [-1.0, 2.0]), (50, [0.0, 0.0]), (3, [5.0, 0.0])]
    got = knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in got.collect()) == brute_top_k(rows)


def test_top_k_deals_few_rows_where_there_are_clusters(spark, monkeypatch):
    """Rows go to the groups that they may matter to: far fewer where vectors have clusters, never too few."""
    r = np.random.default_rng(3)
    middle = 8 * np.eye(6)
    rows = [(i, (middle[i % 6] + 0.05 * r.normal(size=6)).round(4).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(knn, "GROUPS", 6)
    v, size = knn.numbered(df, 256, 50)
    dealt = knn.voronoi(v, size, 5, 50).where("kind = 1").count()
    assert dealt <= 1.1 * len(rows)  # of the 6 groups about one a row
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in knn.top_k(df).collect()) == brute_top_k(rows)


# ---------------------------------------------------------------- 9 quality


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.score(d, quality.fit(d, labels)).join(labels, "doc_id").collect()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got)
    out = [x for x in got if x.held_out]
    good = [x for x in out if x.quality == 1]
    assert sum(x.predicted == x.quality for x in out) / len(out) > 0.96 and sum(x.predicted for x in good) / len(good) > 0.97


def test_quality_odd_rows(spark, docs):
    rows = [(1, "good text " * 20), (2, "BAD!! " * 30), (3, None), (4, ""), (None, "x"), (1, "good text " * 20)]
    few = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, None), (None, 1), (1, 0)], "doc_id long, quality int")
    for labels in (few, few.limit(0), few.where("quality = 1")):
        model = quality.fit(docs(rows), labels)
        got = quality.score(docs(rows), model).collect()
        assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
        assert quality.keep_good(docs(rows), model).columns == docs(rows).columns
        assert quality.score(docs(rows).limit(0), model).count() == 0


# ---------------------------------------------------------------- 10 licenses


def brute_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x.decode() for x in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low.encode())]
    at = sorted((i, x) for p, x in licenses.BASE.items() for n in [p.split()] for i in range(len(w)) if w[i : i + len(n)] == n)
    return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))


def test_licenses(docs):
    r = random.Random(10)
    parts = ["under", "the", "MIT", "license", "License,", "apache", "version", "2", "2.0", "CC", "BY-NC", "by", "nc", "é", "\n", "--", "Ünder"]
    texts = [" ".join(r.choices(parts, k=r.randint(0, 60))) for _ in range(150)]
    texts += ["Under the MIT License", "cc by nc cc by nc", "x " * 3000 + "under the mit license", None, "", "!!!", "Released under the Apache License, Version 2.0. See the LICENSE file", "SPDX-License-Identifier: MIT"]
    got = {x.doc_id: x for x in licenses.scan(docs(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        x = got[i]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == brute_base(t), t
        assert set(filter(None, x.base_labels.split(","))) <= set(filter(None, x.labels.split(","))) and 0 <= x.score <= 1
    assert "apache-2" in got[len(texts) - 2].labels and got[len(texts) - 1].labels == "mit" and got[len(texts) - 1].score > 0.9
    assert licenses.scan(docs([(1, "x")]).limit(0)).count() == 0


def test_license_suppression(docs):
    """A detection inside another of the same or a higher priority does not stand; brute force."""
    texts = ["This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "MIT license and BSD 3-Clause license, all rights reserved", "Permission is hereby granted, free of charge, to any person obtaining a copy under the MIT license"]
    table = licenses.rules()
    for x in licenses.scan(docs(list(enumerate(texts)))).collect():
        norm = " " + " ".join(w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[x.doc_id].lower().encode())) + " "
        all_hits = [(m.start(), -m.end(), -p, n) for n, (_, k, pattern, p) in enumerate(table) if k in norm for m in re.finditer(pattern, norm)]
        stands = [h for h in all_hits if not any(o != h and o[0] <= h[0] and o[1] <= h[1] and o[2] <= h[2] and (o < h or o[2] < h[2]) for o in all_hits)]
        assert sorted(d.label for d in x.detections) == sorted(table[h[3]][0] for h in stands), texts[x.doc_id]
    assert len(table) > 200
