"""French stems: the published examples, and rules worked out by hand."""

import pytest
from pyspark.sql import functions as F

from labelspark.functions.stem import french_stem, marked
from labelspark.operators import features as X

# Word and stem, from the sample vocabulary of the published description.
PUBLISHED = """
continu continu, continua continu, continuait continu, continuant continu, continuation continu, continue continu,
continué continu, continuel continuel, continuelle continuel, continuellement continuel, continuelles continuel,
continuels continuel, continuer continu, continuera continu, continuerait continu, continueront continu, continuez continu,
continuité continu, continuons continuon, contorsions contors, contour contour, contournait contourn, contournant contourn,
contourne contourn, contours contour, contractait contract, contracté contract, contractée contract, contracter contract,
contractés contract, contractions contract, contradictoirement contradictoir, contradictoires contradictoir,
contraindre contraindr, contraint contraint, contrainte contraint, contraintes contraint, contraire contrair,
contraires contrair, contraria contrari, main main, mains main, maintenaient mainten, maintenait mainten,
maintenant mainten, maintenir mainten, maintenue maintenu, maintien maintien, maintint maintint, maire mair, maires mair,
mairie mair, mais mais, maison maison, maisons maison, maistre maistr, maitre maitr, maître maîtr, maîtres maîtr,
maîtresse maîtress, maîtresses maîtress, majesté majest, majestueuse majestu, majestueusement majestu, majestueux majestu,
majeur majeur, majeure majeur, major major, majordome majordom, majorité major, majorités major, mal mal, malade malad,
malades malad, maladie malad, maladies malad, maladive malad
"""


@pytest.fixture(scope="module")
def stems(spark):
    def of(words):
        frame = spark.createDataFrame([(w,) for w in words], "w string")
        return {r.w: r.s for r in frame.select("w", french_stem(F.col("w")).alias("s")).collect()}

    return of


def test_published_examples(stems):
    pairs = dict(p.split() for p in PUBLISHED.replace("\n", " ").split(", "))
    assert stems([w.strip() for w in pairs]) == {w.strip(): s.strip() for w, s in pairs.items()}


def test_consonant_vowels_are_marked(spark):
    words = ["jouer", "ennuie", "yeux", "quand", "croyiez", "aiguë"]
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r.m for r in frame.select(marked(F.col("w")).alias("m")).collect()][:5] == ["joUer", "ennuIe", "Yeux", "qUand", "croYiez"]


def test_rules_by_hand(stems):
    want = {"chevaux": "cheval", "bateaux": "bateau", "finissait": "fin", "chantées": "chant", "premières": "premi", "": "", "xyz": "xyz"}
    assert stems(want) == want


def test_stems_are_made_once_a_word(spark):
    counts = spark.createDataFrame([(1, "maisons", 2), (1, "maison", 1), (2, "majorité", 1), (3, None, 1)], "row_id int, term string, tf int")
    rows = X.stem_terms(counts.filter("term IS NOT NULL"), french_stem, "row_id").collect()
    assert sorted(map(tuple, rows)) == [(1, "maison", 3), (2, "major", 1)]
