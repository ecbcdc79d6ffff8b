"""The pipeline stage by stage, each against a brute-force version on its own input."""

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_llm_small import brute_components
from tokenizers import Tokenizer

import corpus_pipeline
from rankmill.llm import decontaminate, toxicity
from rankmill.session import cut_lineage
from rankmill.sources.tables import table

FOLDER = "/root/testdata/sf0.001"


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, FOLDER), name)
        seen.append(docs)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    given, clean, lines, single, apart, packed = seen
    assert all(x.columns == given.columns for x in (clean, lines, single, apart))
    scorer = toxicity.fit_on(given, table(spark, FOLDER, "labels"))
    assert texts(clean) == {i: t for i, t in texts(given).items() if scorer.score(t) < toxicity.THRESHOLD}
    held = {}
    for i, t in texts(clean).items():
        for x in t.split("\n"):
            held.setdefault(x.strip(" \t\n\x0b\f\r"), set()).add(i)
    often = {k.lower() for k in held if k}  # keys fold A-Z
    count = {k: len(set().union(*(v for x, v in held.items() if x.lower() == k))) for k in often}
    drop = {k for k, n in count.items() if n >= 10}
    assert texts(lines) == {i: "\n".join(x for x in t.split("\n") if x.strip(" \t\n\x0b\f\r").lower() not in drop) for i, t in texts(clean).items()}
    assert lines.where(F.col("n_chars") != F.char_length("text")).count() == 0
    groups = brute_components(list(texts(lines).items()), 5)
    assert texts(single) == {i: t for i, t in texts(lines).items() if groups[i] == i}
    items = [(r["item_id"], decontaminate.plain(r["text"])) for r in table(spark, FOLDER, "benchmark").collect()]
    matcher = decontaminate.Matcher([x for x in items if x[1]], decontaminate.RATE)
    assert texts(apart) == {i: t for i, t in texts(single).items() if not matcher.find(t)}
    reader = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packed.toPandas().sort_values("start")
    for i, t in texts(apart).items():
        ids = np.concatenate([np.frombuffer(b, "<u4") for b in rows[rows["doc_id"] == i]["ids"]]).tolist()
        assert ids == reader.encode(t, add_special_tokens=False).ids + [1]
    assert set(rows["doc_id"]) == set(texts(apart))
    assert corpus_pipeline.ORACLE_SQL is None
