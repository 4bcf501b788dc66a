"""The pipeline on small corpora: run() against a plain version of all stages, and each stage's rows."""

import hashlib
import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from tailrace.llm import mixing, quality, registry, simhash
from tests.llm.test_operators import brute_components, brute_lines_of, made_up, words
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == spark.read.parquet(f"{SF}/documents.parquet").columns
        if name == "simhash":
            rows = before.collect()
            fps = [simhash.fingerprint(r.text) for r in rows]
            # exactly the smallest document of each class stays
            assert sorted(r.doc_id for r in kept[name]) == sorted(set(brute_components(fps, [r.doc_id for r in rows])))
    assert 0 < len(kept["simhash"]) <= len(kept["line_dedup"]) <= len(kept["quality"])
    assert max(Counter(r.doc_id for r in kept["mix"]).values()) <= 3
    assert Counter(r.doc_id for r in kept["bpe"]) == Counter(r.doc_id for r in kept["mix"])
    assert all(r.n_tokens == len(r.ids) for r in kept["bpe"])


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_run(rows, model, targets):
    """The rows of run(): (doc_id, n_tokens, ids, decoded_sha256); rows are (doc_id, text, lang, source, n_chars)."""

    def good(text):
        data, by = (text or "").encode(), quality.compressors(model.dictionaries)
        sizes = [len(data), *(sum(len(c.compress(data[i : i + 1024])) for i in range(0, len(data), 1024)) for c in by)]
        return model.scores(np.array([sizes]))[0] >= 0.7

    rows = [r for r in rows if good(r[1])]
    found = brute_lines_of([(r[0], r[1]) for r in rows])
    rows = [(r[0], kept, *r[2:]) for r, (_, gone, kept) in zip(rows, found, strict=True) if not gone or words(kept)]
    label = brute_components([simhash.fingerprint(r[1]) for r in rows], [r[0] for r in rows])
    one = {}
    for r, x in zip(rows, label, strict=True):
        if r[0] is not None and r[0] == x:
            one[x] = min(one.get(x, r), r, key=lambda q: q[1])
    rows = [*one.values(), *(r for r in rows if r[0] is None)]
    by_source = defaultdict(list)
    for r in rows:
        name = str(r[0]) if r[0] is not None else "null" + hashlib.md5(r[1].encode()).hexdigest()
        by_source[r[3]].append((hashlib.md5(f"7:{name}".encode()).hexdigest(), r[0] is not None, r[0] or 0, len(words(r[1])), r))
    goal = targets({s: sum(d[3] for d in ds) for s, ds in by_source.items()})
    mixed = []
    for s, ds in by_source.items():
        total = sum(d[3] for d in ds)
        budget = min(int(goal[s]), 3 * total)
        whole, before = (budget // total if total else 0), 0
        for *_, size, r in sorted(ds, key=lambda d: d[:4]):
            taken = whole * size + max(0, min(size, budget - whole * total - before))
            before += size
            mixed += [r] * (-(-taken // size) if size else 1)
    library = Tokenizer.from_file(registry.tokenizer_path())
    library.no_truncation()
    library.no_padding()
    out = []
    for r in mixed:
        ids = library.encode(r[1], add_special_tokens=False).ids
        out.append((r[0], len(ids), ids, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out, key=repr)


def small_corpus():
    r = random.Random(12)
    base = [" ".join(made_up(40, 20 + i, 60, 50)[i % 40].split()) + "\n" + "\n".join(f"line {r.randrange(400)} of {r.randrange(9)} things" for _ in range(6)) for i in range(50)]
    junk = ["!!! ### " * r.randint(20, 60) + "X" * r.randint(1, 50) for _ in range(20)]
    shared = "\n".join(f"a passage that several have, line {i}" for i in range(7))
    rows = [(i, t + ("\n" + shared + "\nits own end " + str(i) if i % 7 == 0 else ""), "en", f"src{i % 4}", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, t, None, "src1", None) for i, t in enumerate(junk)]
    rows += [(200 + i, base[i], "en", "src2", 1) for i in range(5)]  # exact copies
    rows += [(300 + i, base[i].replace("things", "matters", 1), "en", None, 1) for i in range(5, 9)]  # near copies
    rows += [(400, None, "en", "src0", 0), (401, "", None, None, 0), (402, " \n ", "de", "src3", 3), (7, base[8], "en", "src2", 5), (7, base[8], "en", "src2", 5), (8, base[8], "en", "src0", 1)]
    rows += [(None, f"without a number {i} " + base[20 + i], "en", f"src{i % 2}", 9) for i in range(12)] + [(None, None, None, None, None), (None, "", "en", "src1", 0)]
    rows += [(500, " ".join(f"word{i % 5000}" for i in range(60000)), "en", "src3", 1)]  # a very long text
    return rows, [(i, 1) for i in range(50)] + [(100 + i, 0) for i in range(20)] + [(None, 1), (3, None), (5, 7)]


def test_run_equals_brute_force(spark, tmp_path):
    rows, labels = small_corpus()
    docs = spark.createDataFrame(rows, COLUMNS)
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    known = spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int")
    known.write.parquet(str(tmp_path / "labels.parquet"))
    model = quality.fit(spark.read.parquet(str(tmp_path / "documents.parquet")), known)

    def targets(sizes):
        frame = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
        return {r.source: r.target for r in frame.collect()}

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = brute_run(rows, model, targets)
    assert len(want) > 40 and any(i is None for i, *_ in want)
    assert sorted(((r.doc_id, r.n_tokens, r.ids, r.decoded_sha256) for r in got), key=repr) == want


@pytest.mark.parametrize("labelled", [True, False])
def test_run_on_empty_tables(spark, tmp_path, labelled):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    (labels if labelled else labels.limit(0)).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_keep_other_columns(spark, tmp_path):
    """Extra columns, with names that operators use themselves, come through all stages but the last."""
    rows, labels = small_corpus()
    docs = spark.createDataFrame(rows[:60], COLUMNS).selectExpr("*", "1 AS size", "'a' AS key", "2 AS range", "3 AS row", "4 AS __id", "5 AS times", "6 AS whole", "7 AS label", "8 AS fp")
    spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        assert docs.columns == before.columns
    assert {(r.size, r.key, r.range, r.row, r.__getattr__("times"), r.whole, r.label, r.fp) for r in docs.collect()} == {(1, "a", 2, 3, 5, 6, 7, 8)}


def test_mix_takes_rows_without_id_each_for_itself(docs):
    rows = [(None, " ".join(["w"] * (5 + i)), "a") for i in range(30)] + [(None, "x y z", "b")] * 10 + [(None, "", "a"), (1, "p q", "c"), (1, "p q r", "c")]
    for range_rows in (5, 2000):
        got = [(r.doc_id, r.text, r.source) for r in mixing.repeated(docs(rows), range_rows=range_rows).collect()]
        taken = Counter()
        for i, t, s in got:
            taken[s] += len(t.split())
        target = {r.source_size: r.target for r in mixing.mix(docs(rows), range_rows=range_rows).collect()}
        size = Counter()
        for _, t, s in rows:
            size[s] += len(t.split())
        assert all(target[size[s]] - 1 < taken[s] < target[size[s]] + 40 for s in size), (taken, target)
        assert got.count((None, "", "a")) == 1
        assert Counter(got) == Counter(x for x in got if x in rows)
