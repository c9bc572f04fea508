import hashlib
import random
import uuid

import corpus_pipeline
from tests.llm.test_pii import brute as brute_spans
from tremorlake.llm.queries import vocab_path


def made():
    r = random.Random(4)
    word = lambda: r.choice("the of and to in water river quake fault signal depth local wave station moves under small large north".split())
    text = lambda n: " ".join(word() for _ in range(n))
    bench = [(i, " ".join(f"{word()}{r.randrange(1000)}" for _ in range(30))) for i in range(3)]
    docs = [(i, text(120)) for i in range(40)]
    docs += [(100 + i, docs[i][1]) for i in range(5)]  # copies
    docs += [(200 + i, f"{text(60)} {bench[i][1]} {text(60)}") for i in range(3)]
    docs += [(300 + i, "x*** y$$$ " * 30) for i in range(3)] + [(310, "few words"), (311, None), (312, "")]
    docs += [(400, text(80) + " mail a.b@c.org or +1 (555) 123-4567 " + text(40))]
    return docs, bench


def test_run(spark, tmp_path):
    from tokenizers import Tokenizer

    docs, bench = made()
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == [*range(40), 400]
    ref = Tokenizer.from_file(vocab_path("word_bpe_49k.json"))
    for i, t in docs:
        if i in got:
            for kind, a, b in sorted((s.split(":") for s in brute_spans(t)), key=lambda s: -int(s[1])):
                t = t[: int(a)] + f"[{kind.upper()}]" + t[int(b) :]
            ids = ref.encode(t, add_special_tokens=False).ids
            assert got[i].ids == ids
            assert got[i].decoded_sha256 == hashlib.sha256(ref.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stages_return_documents(spark):
    df = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in made()[0]], "doc_id long, text string, lang string, source string, n_chars long, _gone string")
    for _, stage in corpus_pipeline.STAGES[:2] + corpus_pipeline.STAGES[3:4]:
        assert stage(spark, df, "").columns == df.columns
        assert stage(spark, df.limit(0), "").count() == 0


def test_python_gets_small_batches(spark, tmp_path, monkeypatch):
    noted, real = tmp_path / "noted", type(spark.range(0)).mapInArrow
    noted.mkdir()

    def noting(self, func, schema, *more):
        def run(batches, folder=str(noted)):
            def passed():
                for b in batches:
                    with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                        f.write(str(b.nbytes))
                    yield b

            return func(passed())

        return real(self, run, schema, *more)

    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", noting)
    spark.createDataFrame([(0, " ".join(f"item{k}" for k in range(20)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, f"word{i} " * 1500, "en", "s", 1) for i in range(900)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    name, before = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            spark.conf.set(name, before)
            stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
    finally:
        spark.conf.set(name, before)
    sizes = [int(p.read_text()) for p in noted.iterdir()]
    assert len(sizes) > 8 and 2 << 20 < max(sizes) < 6 << 20
