"""Dictionaries are built from whole sampled texts."""

from tailrace.llm import quality


def test_dictionaries_see_whole_texts(spark, docs, monkeypatch):
    texts = {i: "".join(f"{i} {'bad' if i % 2 else 'good'} é{n}\n" for n in range(3000)) for i in range(24)}
    seen = []
    real = quality.dictionary
    monkeypatch.setattr(quality, "dictionary", lambda samples: seen.append(b"".join(samples).decode()) or real(samples))
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in texts], "doc_id long, quality int, toxic int")
    quality.fit(docs(list(texts.items())), labels)
    assert len(seen) == 2 and all(seen)
    for all_of_class in seen:
        used = [t for t in texts.values() if t[:50] in all_of_class]
        assert used and all(len(t) > 8000 and t in all_of_class for t in used)
        assert len(all_of_class) == sum(map(len, used))
