"""The pipeline's filters over repeated and null keys."""

from __future__ import annotations

import random

import pytest
from sentencepiece import SentencePieceProcessor

import corpus_pipeline
from sortfolio.llm import pieces, simhash
from tests.llm.conftest import documents
from tests.llm.test_pii import plain_replace


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory, words):
    """Rows, the folder of the other tables, and a clean text maker; toxic texts hold words that no other text has."""
    folder, r = str(tmp_path_factory.mktemp("sf")), random.Random(11)

    def clean(n: int = 60) -> str:
        return " ".join(r.choice(words) for _ in range(n))

    def toxic() -> str:
        return clean(30) + " vilevile nastynasty foulfoul " * 4 + clean(30)

    item = clean(20)
    learnt = [(1000 + i, toxic() if i % 3 == 0 else clean()) for i in range(150)]
    repeated = [(7, clean()), (7, toxic()), (7, clean()), (7, clean() + " " + item + " " + clean()), (7, clean()),
                (None, clean()), (None, toxic()), (None, clean() + " " + item), (None, clean()), (8, clean())]
    copied = [(7, repeated[0][1]), (None, repeated[0][1]), (3, repeated[0][1]), (None, repeated[5][1])]
    spark.createDataFrame([(i, 1, int(k % 3 == 0)) for k, (i, _) in enumerate(learnt)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("b1", item)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = repeated + copied + learnt
    return rows, {t for _, t in rows if "vilevile" in t}, {t for _, t in rows if item in t}, folder


def taken(df) -> list:
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)


def test_toxic_rows_go_one_by_one(spark, corpus):
    rows, toxic, _, folder = corpus
    got = taken(corpus_pipeline.drop_toxic(spark, documents(spark, rows), folder))
    assert got == sorted((r for r in rows if r[1] not in toxic), key=str)


def test_contaminated_rows_go_one_by_one(spark, corpus):
    rows, _, hit, folder = corpus
    got = taken(corpus_pipeline.drop_contaminated(spark, documents(spark, rows), folder))
    assert got == sorted((r for r in rows if r[1] not in hit), key=str)


def test_a_class_keeps_the_row_of_the_smallest_key(spark, corpus):
    rows, folder = corpus[0], corpus[3]
    least: dict = {}
    for i, t in rows:
        if t not in least or (i is not None and (least[t] is None or i < least[t])):
            least[t] = i
    got = taken(corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows), folder))
    assert got == sorted(((i, t) for t, i in least.items()), key=str)


def test_the_whole_run_equals_plain_python(spark, corpus):
    """All five stages over rows with personal data, near copies, toxic and benchmark texts, repeated and null keys."""
    rows, toxic, hit, folder = corpus
    mail = "Mr. John Smith wrote to bob@mail.example.com from 10.1.2.3. Smith called +1 (499) 555-6503."
    clean = [t for _, t in rows if t not in toxic and t not in hit]
    rows = rows + [(2000 + i, f"{t} {mail} {t[::-1]}") for i, t in enumerate(clean[:12])] + [(3000, clean[20] + " " + clean[21] + " é"), (2999, clean[20] + " " + clean[21] + " é")]
    rows += [(4000, None), (4001, ""), (None, "")]
    documents(spark, rows).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    got = sorted(((r.doc_id, list(r.ids), r.n_pieces) for r in corpus_pipeline.run(spark, folder).collect()), key=str)

    # the fitted classifier is taken as it is (its own tests hold it against plain Python); all that follows is computed anew
    kept = taken(corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder))
    assert not {t for _, t in kept} & toxic and len(kept) > 0.9 * sum(t not in toxic for _, t in rows)
    prints = [simhash.fingerprint(t, corpus_pipeline.SHINGLE) for _, t in kept]
    group = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= corpus_pipeline.RADIUS and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    first: dict = {}
    for i, (key, _) in enumerate(kept):
        order = (key is None, key or 0)
        if group[i] not in first or order < first[group[i]][0]:
            first[group[i]] = order, i
    left = [kept[i] for _, i in first.values() if kept[i][1] not in hit]
    library = SentencePieceProcessor(model_file=pieces.MODEL)
    texts = plain_replace([t or "" for _, t in left])
    assert sum("John" in (t or "") for _, t in left) >= 5 and not any("John" in t or "@mail.example" in t for t in texts)
    want = sorted(((k, ids, len(ids)) for (k, _), t in zip(left, texts) for ids in [library.encode(t)]), key=str)
    assert got == want
