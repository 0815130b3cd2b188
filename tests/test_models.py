"""Models are asked cache first: each missing row once, in full batches, in order."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidelex.operators.models import Model, ask_missing, cached, embedded, embedder, labelled, labeller, numbered, reply_labels


def logged(folder, answer):
    """A function that writes each of its calls to a file of its own."""

    def ask(items):
        import uuid

        (folder / uuid.uuid4().hex).write_text(json.dumps(items))
        return [answer(x) for x in items]

    return ask


def calls(folder):
    return [json.loads(p.read_text()) for p in folder.iterdir()]


@pytest.fixture
def asked(tmp_path):
    (tmp_path / "calls").mkdir()
    return tmp_path / "calls"


def test_each_missing_text_once_in_full_batches(spark, tmp_path, asked):
    model = embedder("fake-1", logged(asked, lambda t: [float(len(t)), 1.0]), batch=10)
    rows = spark.range(137).select("id", F.concat(F.lit("text "), (F.col("id") % 73).cast("string")).alias("text")).unionByName(spark.createDataFrame([(900, None), (901, "")], "id long, text string"))
    cache = str(tmp_path / "cache")
    out = embedded(rows.repartition(9), model, cache).collect()
    assert len(out) == 139 and all(r.embedding == (None if r.text is None else [len(r.text), 1.0]) for r in out)
    made = calls(asked)
    assert sorted(map(len, made)) == [4, *[10] * 7]  # 73 texts and the empty one
    assert sorted(t for c in made for t in c) == sorted({f"text {k}" for k in range(73)} | {""})
    embedded(rows, model, cache).collect()
    assert len(calls(asked)) == 8  # nothing is missing any more
    more = rows.unionByName(spark.createDataFrame([(902, "new")], "id long, text string"))
    assert embedded(more, model, cache).where("id = 902").first().embedding == [3.0, 1.0]
    assert sorted(calls(asked), key=len)[0] == ["new"]
    other = embedder("fake-2", logged(asked, lambda t: [0.0]), batch=100)  # a model has a cache of its own
    embedded(rows.limit(1), other, cache).collect()
    assert len(calls(asked)) == 10 and cached(spark, cache, other, "hash").count() == 1 and cached(spark, cache, model, "hash").count() == 75


def test_order_of_batches(spark, tmp_path, asked):
    model = Model("m", logged(asked, lambda r: f"{r['place']}"), "string", 7)
    rows = spark.range(50).select((F.col("id") * 37 % 50).alias("place"), F.col("id").cast("string").alias("key")).repartition(6)
    ask_missing(rows, "key", model, str(tmp_path / "cache"), ["place"])
    assert sorted([r["place"] for r in c] for c in calls(asked)) == [list(range(k, min(50, k + 7))) for k in range(0, 50, 7)]
    assert {r.key: r.answer for r in cached(spark, str(tmp_path / "cache"), model, "key").collect()} == {str(r.key): str(r.place) for r in rows.collect()}


def test_numbered(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.lit("x").alias("__at")).repartition(7)
    assert sorted((r.v, r.n) for r in numbered(rows, ["v"], "n").collect()) == [(k, k) for k in range(1000)]
    assert numbered(rows.limit(0), ["v"], "n").count() == 0


def test_labels_are_coerced_and_missing_answers_asked_again(spark, tmp_path, asked):
    rows = spark.createDataFrame([(f"c{k}", f"text {k}", "head" if k % 2 else None) for k in range(30)], "chunk_id string, text string, heading string")

    def complete(prompt, payload):
        import uuid

        items = json.loads(payload)
        (asked / uuid.uuid4().hex).write_text(payload)
        assert prompt == "label these" and set(items[0]) == {"id", "heading", "text"}
        told = [{"id": x["id"], "label": ("benefits", "mission", "nonsense")[int(x["id"][1:]) % 3]} for x in reversed(items) if x["id"] != "c7"]
        return f"```json\n{json.dumps(told)}\n```"

    model = labeller("labels-1", complete, "label these", batch=25)
    cache = str(tmp_path / "cache")
    out = {r.chunk_id: r.label for r in labelled(rows, model, cache, ["mission", "benefits", "junk"], "junk").collect()}
    assert out == {f"c{k}": None if k == 7 else ("benefits", "mission", "junk")[k % 3] for k in range(30)}
    assert sorted(map(len, calls(asked))) == [5, 25]
    labelled(rows, model, cache, ["mission", "benefits", "junk"], "junk").collect()
    assert sorted(map(len, calls(asked))) == [1, 5, 25]


@pytest.mark.parametrize("reply", ['[{"id": 1, "label": "a"}]', '```json\n[{"id": "1", "label": "a"}]\n```', '  ```[{"id": "1", "label": "a"}]```  '])
def test_replies(reply):
    assert reply_labels(reply) == {"1": "a"}


@pytest.mark.parametrize("reply", ["", "no", '{"id": 1}', '[{"id": 1}]'])
def test_bad_replies(reply):
    with pytest.raises(ValueError, match="not a JSON array"):
        reply_labels(reply)


def test_a_model_that_answers_too_little(spark, tmp_path):
    model = Model("short", lambda rows: [], "string", 5)
    rows = spark.createDataFrame([("a",)], "key string")
    with pytest.raises(Exception, match="gave 0 answers for 1 rows"):
        ask_missing(rows, "key", model, str(tmp_path / "cache"), ["key"])
    assert cached(spark, str(tmp_path / "cache"), model, "key").count() == 0


def test_several_models_are_asked_for_the_same_rows(spark, tmp_path, asked):
    """No model gets what another one said, and each is asked once for a row that repeats."""
    from tidelex.operators.models import labelled_by

    rows = spark.createDataFrame([(f"c{k % 8}", f"text {k % 8}") for k in range(20)], "chunk_id string, text string").repartition(5)
    models = [(Model(name, logged(asked, lambda r, name=name: f"{name} {r['text']}"), "string", 3), [f"{name} text {k}" for k in range(7)], "other", name) for name in ("m", "n")]
    got = labelled_by(rows, models, str(tmp_path / "cache")).collect()
    assert len(got) == 20 and all((r.m, r.n) == (("other", "other") if r.chunk_id == "c7" else (f"m {r.text}", f"n {r.text}")) for r in got)
    made = calls(asked)
    assert sorted(map(len, made)) == [2, 2, 3, 3, 3, 3] and all(set(r) == {"chunk_id", "text"} for c in made for r in c)
