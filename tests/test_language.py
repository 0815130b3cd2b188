"""Languages by character n-grams: held-out accuracy on the fixture, and languages that no profile knows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidelex import catalog
from tidelex.functions.language import OTHER, is_english, language_of, learn, letters, text_runs

#: Plain sentences to learn four languages from; others to tell, and some of languages that are not learned.
LEARNED = {
    "en": "We are looking for people who want to build things that matter. Our teams work together across many countries and time zones. You will learn from the people around you and they will learn from you. Every day brings new questions and we try to answer them with care. The best ideas often come from someone who has just joined. We offer good pay, time to rest and the freedom to choose how you work. What you do here will be used by many people all over the world. If this sounds like something you would like to do, then write to us. There is no single way to become an engineer, and we have met people who came to it from music, from farming and from the law. Most of what we know we have learned from our mistakes.",
    "de": "Wir suchen Menschen, die Dinge bauen wollen, auf die es ankommt. Unsere Gruppen arbeiten über viele Länder und Zeitzonen hinweg zusammen. Du wirst von den Leuten um dich herum lernen und sie werden von dir lernen. Jeder Tag bringt neue Fragen und wir versuchen, sie mit Sorgfalt zu beantworten. Die besten Ideen kommen oft von jemandem, der gerade erst angefangen hat. Wir bieten gute Bezahlung, Zeit zur Erholung und die Freiheit zu wählen, wie du arbeitest. Was du hier machst, wird von vielen Menschen auf der ganzen Welt benutzt. Wenn das nach etwas klingt, das du gerne machen würdest, dann schreib uns. Es gibt nicht nur einen Weg, und wir haben Leute getroffen, die aus der Musik oder der Landwirtschaft kamen.",
    "fr": "Nous cherchons des personnes qui veulent construire des choses qui comptent. Nos équipes travaillent ensemble dans de nombreux pays et fuseaux horaires. Vous apprendrez des gens qui vous entourent et ils apprendront de vous. Chaque jour apporte de nouvelles questions et nous essayons d'y répondre avec soin. Les meilleures idées viennent souvent de quelqu'un qui vient d'arriver. Nous offrons un bon salaire, du temps pour se reposer et la liberté de choisir comment travailler. Ce que vous ferez ici sera utilisé par beaucoup de gens dans le monde entier. Si cela ressemble à quelque chose que vous aimeriez faire, alors écrivez-nous. Il n'y a pas qu'un seul chemin, et nous avons rencontré des gens venus de la musique ou de la ferme.",
    "es": "Buscamos personas que quieran construir cosas que importan. Nuestros equipos trabajan juntos en muchos países y zonas horarias. Aprenderás de la gente que te rodea y ellos aprenderán de ti. Cada día trae nuevas preguntas y tratamos de responderlas con cuidado. Las mejores ideas vienen a menudo de alguien que acaba de llegar. Ofrecemos un buen sueldo, tiempo para descansar y la libertad de elegir cómo trabajar. Lo que hagas aquí será usado por mucha gente en todo el mundo. Si esto suena como algo que te gustaría hacer, entonces escríbenos. No hay un solo camino, y hemos conocido a personas que vinieron de la música o del campo.",
}
TOLD = {
    "en": "Our offices are open to everyone, and nobody has to ask before they bring a friend to lunch.",
    "de": "Unsere Büros stehen allen offen, und niemand muss fragen, bevor er einen Freund zum Essen mitbringt.",
    "fr": "Nos bureaux sont ouverts à tous, et personne ne doit demander avant d'amener un ami au déjeuner.",
    "es": "Nuestras oficinas están abiertas a todos, y nadie tiene que preguntar antes de traer a un amigo a comer.",
}
STRANGE = {
    "it": "Cerchiamo persone che vogliano costruire cose importanti. I nostri gruppi lavorano insieme in molti paesi, e ogni giorno ci porta nuove domande a cui cerchiamo di rispondere con cura.",
    "nl": "Wij zoeken mensen die dingen willen bouwen die ertoe doen. Onze groepen werken samen in veel landen, en elke dag brengt nieuwe vragen die wij zorgvuldig proberen te beantwoorden.",
    "sv": "Vi söker människor som vill bygga saker som betyder något. Våra grupper arbetar tillsammans i många länder, och varje dag kommer nya frågor som vi försöker svara noga på.",
    "fi": "Etsimme ihmisiä, jotka haluavat rakentaa tärkeitä asioita. Ryhmämme työskentelevät yhdessä monissa maissa, ja joka päivä tuo uusia kysymyksiä.",
    "ru": "Мы ищем людей, которые хотят создавать важные вещи. Наши группы работают вместе во многих странах.",
}


@pytest.fixture(scope="module")
def plain(spark):
    rows = [(lang, s + ".") for lang, t in LEARNED.items() for s in t.split(". ")] + [(None, "x y z"), ("en", None)]
    return learn(spark.createDataFrame(rows, "lang string, text string"), tolerance=4.0)


def test_known_and_unknown_languages(spark, plain):
    rows = spark.createDataFrame([*TOLD.items(), *((OTHER, STRANGE[k]) for k in ("sv", "fi", "ru")), (None, None), (None, "12 34"), (None, "")], "want string, text string")
    got = rows.withColumn("found", language_of(F.col("text"), plain)).collect()
    assert [(r.want, r.found, r.text) for r in got if r.found != r.want] == []
    assert not {plain.language(STRANGE[k]) for k in STRANGE} & {"en"}  # close relatives of a known language may pass for it, but none for English


def test_english(spark, plain):
    texts = [TOLD["en"], *(t for k, t in (TOLD | STRANGE).items() if k != "en"), "zu kurz", "12345 67890 12345 67890 12345 67890 12345 67890", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    got = [r.e for r in rows.withColumn("e", is_english(F.col("text"), plain)).orderBy("k").collect()]
    assert got == [True, *[False] * (len(texts) - 4), True, True, None]


def test_held_out_accuracy_on_the_fixture(spark, middle):
    docs = spark.read.parquet(f"{middle}/documents.parquet").where(F.length("text") >= 40)
    profile = learn(docs.where("doc_id % 3 <> 0"))
    rows = docs.where("doc_id % 3 = 0").select("lang", language_of(F.col("text"), profile).alias("found")).collect()
    right = sum(r.lang == r.found for r in rows) / len(rows)
    print(f"held-out accuracy {right:.4f} of {len(rows)}")
    assert right >= 0.95
    assert {language_of_text for language_of_text in (profile.language(t) for t in [STRANGE["ru"], STRANGE["fi"]])} == {OTHER}


def test_an_empty_table(spark):
    profile = learn(spark.createDataFrame([], "lang string, text string"))
    assert profile.languages == [] and profile.language("anything at all") is None


def test_runs():
    assert letters("It's 5 o'clock!") == " it s o clock " and text_runs("ab") == ["a", "b", " a", "ab", "b ", " ab", "ab "] and text_runs("42") == []


def test_the_query_learns_from_labelled_texts_only(spark, small):
    rows = catalog.QUERIES["detected_languages"](spark, small).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    known = [r for r in rows if len(docs[r.doc_id].text or "") >= 40]
    assert sum(r.language == docs[r.doc_id].lang for r in known) >= 0.9 * len(known)


def test_means_by_codes():
    """What codes of runs count is what their strings count, for known and unknown runs and letters beyond 16 bits."""
    import numpy as np

    from tidelex.functions.language import Profile, text_runs

    known = sorted({r for t in ("Das ist gut", "caf\u00e9 \U00020000\U00020001 x") for r in text_runs(t)})
    p = Profile(["a", "b"], {r: i for i, r in enumerate(known)}, np.random.default_rng(1).normal(size=(len(known) + 1, 2)), np.zeros(2))
    for t in ("das ist", "\U00020001 caf\u00e9 zzz", "q", "Gut, gut! 12 x\U00020000"):
        found = text_runs(t)
        want = np.bincount([p.places.get(r, len(known)) for r in found], minlength=len(known) + 1) @ p.weights / len(found)
        assert np.array_equal(p.means(t), want)
    assert p.means("12 !") is None
    assert np.array_equal(Profile(["a"], {}, np.ones((1, 1)), np.zeros(1)).means("ab"), [1.0])


def test_every_text_sets_the_threshold(spark):
    """Thresholds by hand: each text in pieces under counts of the texts of other parts, all texts of a language, however many."""
    import math
    import random
    import zlib
    from collections import Counter

    rnd = random.Random(7)
    rows = [(lang, " ".join(rnd.choices(words, k=rnd.randint(3, 90)))) for lang, n in (("en", 2100), ("de", 40)) for words in [LEARNED[lang].lower().split()] for _ in range(n)]
    rows += [("fr", LEARNED["fr"])] * 3  # one part only: no threshold
    parts = {t: zlib.crc32(t.encode()) % 3 for _, t in rows}
    profile = learn(spark.createDataFrame(rows, "lang string, text string"), runs=10_000, tolerance=2.0)
    counts = {(lang, k): Counter() for lang in ("en", "de", "fr") for k in range(3)}
    for lang, t in rows:
        counts[lang, parts[t]].update(text_runs(t))
    known = {r for c in counts.values() for r in c}
    for lang in ("en", "de"):
        means = []
        for k in range(3):
            rest = counts[lang, (k + 1) % 3] + counts[lang, (k + 2) % 3]
            whole = rest.total()
            for x, t in rows:
                if x == lang and parts[t] == k:
                    flat = letters(t)
                    for i in range(0, max(1, len(flat) - 100), 200):
                        found = text_runs(flat[i : i + 200])
                        means.append(sum(math.log((rest[r] + 0.5) / (whole + 0.5 * (len(known) + 1)) if r in known else 0.05 / (whole + 1)) for r in found) / len(found))
        mean = sum(means) / len(means)
        sd = math.sqrt(sum((m - mean) ** 2 for m in means) / len(means))
        assert profile.least[profile.languages.index(lang)] == pytest.approx(mean - 2 * max(sd, 0.1), abs=1e-9)
    assert profile.least[profile.languages.index("fr")] == -math.inf
