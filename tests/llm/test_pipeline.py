"""The pipeline's stages against what they promise, on a small table."""

import base64
import random

import corpus_pipeline
from terraframe.llm import language, sharding


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, seen[-1], sf).write.parquet(path)
        seen.append(spark.read.parquet(path))
        if k < 4:
            assert seen[-1].columns == docs.columns
    counts = [x.count() for x in seen]
    assert counts[0] >= counts[1] > counts[2] >= counts[3] > 0 and counts[5] == counts[4]
    assert language.UNKNOWN not in {r["lang"] for r in seen[1].select("lang").distinct().collect()}
    assert seen[2].select("doc_id").distinct().count() == counts[2]
    assert counts[2] - counts[3] <= 0.1 * counts[2]
    worst = max(r["bytes"] for r in seen[5].where("NOT over_limit").groupBy("shard").agg({"n_bytes": "sum"}).withColumnRenamed("sum(n_bytes)", "bytes").collect())
    assert worst <= sharding.LIMIT_BYTES


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and "doc_id" in out.columns


def test_foreign_texts_go_and_clean_short_ones_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(3)
    foreign = [
        "в начале было слово и слово было у бога и слово было бог все через него начало быть",
        "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem",
        "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto",
        "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(60)),
        base64.b64encode(rng.randbytes(3000)).decode(),
        *(" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(n)) for n in (8, 20, 500)),
    ]
    clean = [r["text"] for r in docs.where(language.held_out()).orderBy("doc_id").limit(60).collect()]
    short = [" ".join(t.split()[:n]) for t in clean for n in (1, 2, 5, 20)]
    long = " ".join(r["text"] for r in docs.where("lang = 'en'").orderBy("doc_id").limit(300).collect())
    repeated = [f"{w} " * 500 for w in ("The", "Für", "Queelle", "Osas", "Ofanheanly")]
    rows = [(10**6 + k, t, None, "s", len(t)) for k, t in enumerate([*foreign, *clean, *short, long, *repeated])]
    planted = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    kept = {r["doc_id"] for r in corpus_pipeline.identify(spark, planted, "").select("doc_id").collect()}
    assert not [t[:40] for k, t in enumerate(foreign) if 10**6 + k in kept]
    gone = [t for i, t, *_ in rows[len(foreign) :] if i not in kept and language.letters(t).any()]
    assert not gone
    assert docs.count() == len([i for i in kept if i < 10**6])


def nasty(spark):
    """Nulls in any column, empty and very long texts, repeated rows, a benchmark passage, columns named like the operators' own."""
    rng = random.Random(7)
    own = {"en": "the and of with that from".split(), "de": "der und die nicht mit auch".split(), "fr": "le et les dans avec pour".split()}
    text = lambda lang, n: " ".join(rng.choice(own[lang]) + rng.choice(["a", "en", "or", "il"]) for _ in range(n))
    rows = [(k, text(lang, 30 + k % 20), lang, f"s{k % 3}") for k, lang in enumerate(list(own) * 30)]
    bench = text("en", 40)
    rows += [(100, None, "en", "s0"), (101, "", "en", "s0"), (102, " 12 !?", "de", None), (103, text("fr", 30_000), None, "s1"), (104, rows[3][1], "en", None), (105, rows[3][1], "en", None), (105, rows[3][1], "en", None), (None, text("de", 50), "de", "s2"), (106, text("en", 60) + " " + bench, "en", "s1"), (107, bench, "en", "s1"), (108, "x", "fr", "s2")]
    schema = "doc_id long, text string, lang string, source string, score double, items string, row string, n long, h long, position double, shard string, lang_pred string, hit_spans int"
    docs = spark.createDataFrame([(*r, 0.5, "i", "r", 1, 2, 0.1, "sh", "lp", 3) for r in rows], schema)
    return rows, docs, spark.createDataFrame([(1, bench), (2, None), (None, "")], "item_id long, text string")


def test_each_stage_on_nasty_tables(spark, tmp_path):
    rows, docs, benchmark = nasty(spark)
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    stages, sf = dict(corpus_pipeline.STAGES), str(tmp_path)
    everything = lambda df: sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in df.collect())

    kept = stages["language"](spark, docs, sf)
    assert kept.columns == docs.columns
    assert {r["lang_pred"] for r in kept.collect()} == {"lp"}  # the column of that name is the document's own
    gone = set(everything(docs)) - set(everything(kept))
    assert {100, 101, 102} <= gone <= {100, 101, 102, 108}

    kept = stages["dedup"](spark, docs, sf)
    assert kept.columns == docs.columns
    assert everything(kept) == sorted([-1, *range(90), 100, 101, 102, 103, 106, 107, 108])  # 104 and 105 repeat 3

    kept = stages["decontaminate"](spark, docs, sf)
    assert kept.columns == docs.columns and everything(kept) == sorted(i for i in everything(docs) if i != 107)
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert texts[100] is None and texts[101] == "" and texts[0] == rows[0][1] and texts[103] == rows[93][1]
    assert rows[99][1].startswith(texts[106].strip()) and len(texts[106].split()) == 60 or len(texts[106].split()) >= 60

    kept = stages["mix"](spark, docs, sf)
    assert kept.columns == docs.columns
    copies = everything(kept)
    assert not {100, 101} & set(copies) and max(copies.count(i) for i in set(copies) - {105}) <= 3
    assert copies == everything(stages["mix"](spark, docs.repartition(3), sf))

    last = stages["shard"](spark, docs, sf)
    assert everything(last) == everything(docs) and {r["n_bytes"] for r in last.where("doc_id IN (100, 101)").collect()} == {0}

    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), sf)
        assert empty.count() == 0 and (name == "shard" or empty.columns == docs.columns), name
