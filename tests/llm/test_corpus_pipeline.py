import random

import corpus_pipeline
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from test_decontamination import least_distance
from test_minhash_dedup import sets
from test_secret_ledger import brute as secrets

from tidepanel.llm import byte_bpe, decontamination


def folder_of(spark, tmp_path, docs, labels, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    prose = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(prose(20))) for i in range(5)]
    texts = [" ".join(prose(rng.randint(20, 60))) for _ in range(120)]
    texts += [" ".join(x[:10] + ["youidiot"] * 2 + x[10:]) for x in (prose(30) for _ in range(60))]
    base = prose(120)
    for _ in range(15):
        copy = list(base)
        copy[rng.randrange(120)] = word()
        texts.append(" ".join(copy))
    texts += [f"{texts[0]} {items[i % 5][1].replace('a', 'e', 2)} {' '.join(prose(30))}" for i in range(8)]
    texts += [texts[3], texts[3], f"{' '.join(prose(40))} token=abcdef12 é {word()}", ""]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(None, None, "en", "s", 0)]
    labels = [(i, 1, int("youidiot" in t)) for i, t in enumerate(texts) if i % 2]
    return docs, labels, items


def test_equals_brute_force(spark, tmp_path):
    docs, labels, items = corpus()
    folder = folder_of(spark, tmp_path, docs, labels, items)
    left = {i: t for i, t, *_ in docs if i is not None and "youidiot" not in t}
    whole, label = sets(list(left.items())), {i: i for i in left}

    def root(i):
        return i if label[i] == i else root(label[i])

    for a in left:
        for b in left:
            if a < b and whole[a] and 10 * len(whole[a] & whole[b]) >= 8 * len(whole[a] | whole[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    left = {i: t for i, t in left.items() if root(i) == i}
    plain = [decontamination.normalise(t) for _, t in items]
    left = {i: t for i, t in left.items() if not any(least_distance(p, decontamination.normalise(t)) <= int(0.08 * len(p)) for p in plain)}
    for i, t in left.items():
        for span in reversed([x for x in secrets(t).split(",") if x]):
            kind, a, b = span.split(":")
            t = f"{t[: int(a)]}[{kind}]{t[int(b) :]}"
        left[i] = t
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe._ranks(byte_bpe.RANKS), special_tokens={})
    want = {i: library.encode_ordinary(t) for i, t in left.items()} | {None: []}
    got = corpus_pipeline.run(spark, folder).collect()
    assert len(got) == len(want)
    assert {r.doc_id: r.ids for r in got} == want


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs, labels, items = corpus()
    folder = folder_of(spark, tmp_path, docs, labels, items)
    given = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, given, folder).columns == given.columns
    redacted = corpus_pipeline.redact_secrets(spark, given, folder).where("text LIKE '%[assign]%'").collect()
    assert len(redacted) == 1 and redacted[0].n_chars == len(redacted[0].text)


def test_columns_that_stages_make_may_stand_in_the_table(spark, tmp_path):
    docs, labels, items = corpus()
    folder = folder_of(spark, tmp_path, docs, labels, items)
    given = spark.read.parquet(f"{folder}/documents.parquet")
    names = ["score", "evidence", "hits", "spans", "sha", "path", "kept", "component_id", "_text", "v", "held out"]
    clashing = given.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, clashing, folder)
        assert found.columns == clashing.columns
        rows = found.collect()
        assert {r.doc_id for r in rows} == {r.doc_id for r in stage(spark, given, folder).collect()}
        assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names if r.doc_id is not None)


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder_of(spark, tmp_path, [], [], [])).collect() == []
