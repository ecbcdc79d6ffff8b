"""The dealt methods against plain versions, and the edges of odd tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from rankmill.llm import ann, line_dedup, near_dedup, pii, toxicity, warc
from rankmill.session import cut_lineage

WORDS = [f"w{i}" for i in range(300)]


def plain_em(votes, lexicon, rounds=60):
    """The label model, voter by voter and row by row."""
    rows, voters = len(votes), len(votes[0])
    post = [0.01 + 0.98 * s / (s + 0.25) for s in (sum(v[:lexicon]) for v in votes)]
    for _ in range(rounds):
        prior = min(max(sum(post) / rows, 1e-4), 1 - 1e-4)
        fire = []
        for weight in ([1 - p for p in post], post):
            total = sum(weight)
            fire.append([min(max((sum(w * v[j] for w, v in zip(weight, votes)) + 0.5) / (total + 1), 1e-4), 1 - 1e-4) for j in range(voters)])
        cov = [[sum(
            (1 - p) * (v[i] - fire[0][i]) * (v[j] - fire[0][j]) + p * (v[i] - fire[1][i]) * (v[j] - fire[1][j]) for v, p in zip(votes, post)
        ) for j in range(voters)] for i in range(voters)]
        sd = [math.sqrt(max(cov[i][i], 1e-9)) for i in range(voters)]
        weight = [1 / (1 + sum(max(cov[i][j] / sd[i] / sd[j], 0) ** 2 for j in range(voters) if j != i)) for i in range(voters)]
        new = []
        for v in votes:
            score = math.log(prior / (1 - prior)) + sum(weight[j] * math.log(fire[1][j] / fire[0][j]) for j in range(voters) if v[j])
            new.append(1 / (1 + math.exp(-min(max(score, -30), 30))))
        moved = max(abs(a - b) for a, b in zip(new, post))
        if moved < 1e-6:
            break
        post = new
    return new


def votes_of(rng, rows=120, lexicon=5):
    toxic = [rng.random() < 0.25 for _ in range(rows)]
    votes = []
    for t in toxic:
        own = [float(rng.random() < (0.6 if t else 0.02)) for _ in range(lexicon)]
        votes.append([*own, float(not any(own)), float(rng.random() < 0.3), own[0]])  # the last repeats the first
    return toxic, votes


def test_label_model_against_plain_em():
    toxic, votes = votes_of(random.Random(4))
    model = toxicity.LabelModel().fit(np.array(votes), 5)
    got = model.posterior(np.array(votes))
    assert np.allclose(got, plain_em(votes, 5), atol=1e-4)
    assert np.mean((got > 0.5) == np.array(toxic)) > 0.95
    assert model.weight[0] < model.weight[1]  # a voter that repeats another counts less


def test_labels_choose_terms_only():
    """From the chosen voters on nothing is read from labels: the fit has no argument for them."""
    import inspect

    assert list(inspect.signature(toxicity.fit).parameters) == ["voters", "others", "has", "marks"]
    assert list(inspect.signature(toxicity.LabelModel.fit).parameters) == ["self", "votes", "lexicon", "rounds"]


def test_silence_and_patterns_vote():
    lexicon, marked = np.array([[0, 1], [0, 0]], float), np.array([[1], [0]], float)
    assert toxicity.all_votes(lexicon, marked).tolist() == [[0, 1, 0, 1], [0, 0, 1, 0]]


# ---- personal data: terms by plain counting


def plain_terms(rows, alpha=pii.ALPHA, contexts=pii.CONTEXTS):
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    words = lambda t: set(re.findall(r"[^\W_]+", t.lower()))
    total = len(rows)
    n_t, n_e, n_te, lines = Counter(), Counter(), Counter(), defaultdict(set)
    for _, text in rows:
        n_t.update(words(text or ""))
        held, both = set(), set()
        for line in (text or "").split("\n"):
            own = words(mail.sub(" ", line))
            for value in map(str.lower, mail.findall(line)):
                name = re.match("[a-z]{3,}", value)
                for e in ["email:" + value, "host:" + value.split("@")[1], *(["name:" + name[0]] if name else [])]:
                    held.add(e)
                    both |= {(e, t) for t in own}
                    for t in own:
                        lines[e, t].add(line)
        n_e.update(held)
        n_te.update(both)
    risky = set()
    for (e, t), n in n_te.items():
        content = math.log2(total / n_e[e])
        sure = 1 if len(lines[e, t]) >= contexts else n / (n + pii.PRIOR)
        pmi = math.log2(n * total / (n_t[t] * n_e[e]))
        if content > 0 and sure * pmi >= alpha * content - 1e-9:
            risky.add(t)
    return risky


def test_terms_against_plain_counts(spark):
    rng = random.Random(9)
    rows = []
    for i in range(160):
        text = [" ".join(rng.choice(WORDS) for _ in range(12)) for _ in range(3)]
        if i % 4 == 0:
            k = rng.randrange(12)
            text[1] += f" agent{k} of unit{k % 3} is anna{chr(97 + k)}.{k}@h{k % 4}.example.org " + rng.choice(["soon", "later"])
        rows.append((i, "\n".join(text)))
    risky = plain_terms(rows)
    out = pii.personal_data(spark.createDataFrame([(i, t, "x", 1, "t") for i, t in rows], "doc_id long, text string, _doc string, _of int, _terms string"))
    assert out.columns == ["doc_id", "text", "_doc", "_of", "_terms", "_base", "_spans"]
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    assert any(t.startswith("agent") for t in risky)
    for r in out.collect():
        got = {s["value"].lower() for s in r["_spans"] if s["kind"] == "term"}
        assert got == {w for w in re.findall(r"[^\W_]+", r["text"].lower()) if w in risky}
        assert (r["_doc"], r["_of"], r["_terms"]) == ("x", 1, "t") and [s["value"] for s in r["_base"]] == mail.findall(r["text"])


# ---- edges


def test_repeated_ids_are_one_node(spark):
    rng = random.Random(1)
    a, b = (" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(2))
    rows = [(2, a), (5, a), (5, b), (9, b), (11, "other words"), (5, None), (11, "other words")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4)
    assert sorted((r["doc_id"], r["component_id"]) for r in got.where("n_shingles > 0").collect()) == [(2, 2), (5, 2), (5, 2), (9, 2), (11, 11), (11, 11)]


def test_pipeline_of_odd_rows(spark):
    """Nulls, empties, repeated ids, rows without an id, clashing names and a long text, stage by stage."""
    rng = random.Random(2)
    a, b = (" ".join(rng.choice(WORDS) for _ in range(80)) for _ in range(2))
    long = "\n".join(f"line {i} {rng.random()}" for i in range(100_000))
    rows = [(2, a), (5, a), (5, b), (9, b), (11, "solo text"), (11, "solo text"), (12, None), (13, ""), (None, a), (None, a), (None, None), (20, long)]
    rows += [(100 + i, f"shared line\nown {i} {rng.random()}") for i in range(12)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _doc string, _of int, _dropped long, _place int"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "d", 1, 2, 3) for i, t in rows], schema)
    folder = "/root/testdata/sf0.001"
    for given in (docs, docs.limit(0)):
        at = cut_lineage(given, "odd")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            at = cut_lineage(stage(spark, at, folder), name)
            assert at.columns == docs.columns
            if name == "near_dedup" and given is docs:
                kept = Counter(r["doc_id"] for r in at.select("doc_id").collect())
                assert kept == Counter([2, 11, 12, 13, 20, None, None, None, *range(100, 112)])
                assert {r["_doc"] for r in at.collect()} == {"d"} and at.where("text = ''").count() >= 2
                assert at.where("text LIKE '%shared line%'").count() == 0 and at.where("doc_id = 20").first()["text"] == long
        packed = corpus_pipeline.STAGES[-1][1](spark, at, folder)
        assert (packed.count() > 0) == (given is docs)


def test_many_dropped_lines(spark):
    """One dropped line in each word of the bitmap: the work is linear, the text exact."""
    n = 300_000
    text = "\n".join("drop" if i % 64 == 5 else f"line {i}" for i in range(n))
    docs = cut_lineage(spark.createDataFrame([(0, text), *((i, f"drop\nx{i}") for i in range(1, 12)), (20, None)], "doc_id long, text string"), "docs")
    out = line_dedup.with_bitmaps(docs, cut_lineage(line_dedup.dropped_lines(docs, 10), "bitmaps"))
    got = {r["doc_id"]: (r["kept"], r["n"]) for r in out.select("doc_id", line_dedup.kept_text().alias("kept"), line_dedup.n_dropped().alias("n")).collect()}
    assert got[0] == ("\n".join(x for x in text.split("\n") if x != "drop"), len([i for i in range(n) if i % 64 == 5]))
    assert got[3] == ("x3", 1) and got[20] == ("", 0)


def test_usual_length_of_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(0, [1.0])] + [(i, rng.normal(size=8).tolist()) for i in range(1, 200)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 5)
    assert {r["query_id"] for r in got.collect()} == {50, 100, 150} and got.count() == 15


def test_archives_are_read_in_parallel(spark, monkeypatch):
    """As many tasks as archives in the normaliser and the reader, and copies travel without their payload."""
    pages = spark.createDataFrame([(i, f"http://h/{i}", "same page" if i % 3 == 0 else f"page {i}") for i in range(120)], "page_id long, url string, html string")
    records = warc.with_revisits(pages, 0, "page_id", "url", "html")
    assert records.where("first IS NOT NULL").select(F.count("payload")).first()[0] == 0 and records.where("first IS NOT NULL").count() == 39
    folder = str(warc.shared_folder(spark, "warc"))
    files = warc.write_archives(records.repartition(6), f"{folder}/whole")
    assert files.count() == 6
    index = warc.normalise(files, f"{folder}/members")
    assert index.select("archive").distinct().count() == 6
    out = warc.read_records(index)
    assert out.rdd.getNumPartitions() >= 6 and out.count() == 120
