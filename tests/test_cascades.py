"""The shipped rules on texts that fire each of them."""

from __future__ import annotations

import pytest

from tidelex import catalog

#: (text, register, stance), by the reference's heuristics (dei.py, dei_stance.py).
CASES = [
    ("Our Warfighters need diversity.", "civilizational_mission", "civilizational_mission"),
    ("The west's most important tools, judged by outcomes.", "civilizational_mission", "civilizational_mission"),
    ("You are JUDGED BY OUTCOMES; belonging.", "meritocracy", "performance_elite"),
    ("A refuge from division and bias.", "meritocracy", "mission_focus_apolitical"),
    ("We don't engage in social causes.", "meritocracy", "mission_focus_apolitical"),
    ("We do not engage in social causes.", "meritocracy", "neutral"),
    ("We build a family of parts with a dream team.", "absent", "performance_elite"),
    ("Plain words of a team.", "absent", "neutral"),
    ("Diverse veterans: a target of 10.", "explicit_demographic", "neutral"),
    ("Inclusive to Black and Latinx colleagues.", "aspirational_vague", "neutral"),
    ("Diverse women partner here.", "aspirational_vague", "neutral"),
    ("Diverse women, 40% of us.", "explicit_demographic", "neutral"),
    ("Diverse women, 40% of us, in breast cancer care.", "aspirational_vague", "neutral"),
    ("We audit for bias.", "structural_process", "neutral"),
    ("Merit, not favour.", "meritocracy", "neutral"),
    ("Bring your whole self.", "belonging_culture", "affirming_dei"),
    ("Inclusion and equity.", "aspirational_vague", "affirming_dei"),
    ("Inclusion alone.", "aspirational_vague", "neutral"),
    ("Apolitical by choice.", "absent", "mission_focus_apolitical"),
    (None, None, None),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("cascades")
    frame = spark.createDataFrame([(k, t, "en", "acme") for k, (t, _, _) in enumerate(CASES)], "doc_id long, text string, lang string, source string")
    frame.toPandas().to_parquet(path / "documents.parquet")
    return str(path)


def test_every_rule_fires(spark, folder):
    got = {r.doc_id: (r.register, r.stance) for r in catalog.QUERIES["shipped_cascades"](spark, folder).collect()}
    assert got == {k: (r, s) for k, (_, r, s) in enumerate(CASES)}


def test_same_as_sql_on_every_rule(spark, folder):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.execute(catalog.ORACLE_SQL["shipped_cascades"]).fetchall()
    assert sorted(want) == sorted(map(tuple, catalog.QUERIES["shipped_cascades"](spark, folder).select("doc_id", "register", "stance").collect()))
