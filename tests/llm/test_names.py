import random

from conftest import rows
from covertrace.llm import name_variants as nv

OUTLETS = [(1, "The Vellabury Evening Post", "vellaburyeveningpost.example"), (2, "Vellabury Ledger", "vellabury-ledger.example"), (3, "Diario de Tarrecôte", "tarrecotediario.example"), (4, "Tardagårder Rundschau", None), (5, "The Haldarick Courier", "haldarickcourier.example"), (6, "Hallarick Courier", "hallarickcourier.example")]
PEOPLE = [(10, "Søren Drainåd", 1), (11, "Francisco L. Ulvtugaard", 1), (12, "Søren Drainåd", 3), (13, "Åse Vellamann", 2), (14, "Anna Berg", 5), (15, "Anders Berg", 5)]
ROWS = "row_id long, outlet_name string, outlet_domain string, url string, byline string, id string"


def levenshtein(a, b):
    """Optimal string alignment distance by the whole table."""
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_banded_distance_and_segments_equal_brute_force():
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abc", k=rng.randint(3, 12)))
    forms = [word() for _ in range(300)]
    index = nv.SegmentIndex((f, i, 0) for i, f in enumerate(forms))
    for _ in range(400):
        a, b = word(), rng.choice(forms)
        for k in (0, 1, 2):
            assert nv.within(a, b, k) == min(k + 1, levenshtein(a, b))
        expected = {i for i, f in enumerate(forms) if levenshtein(a, f) <= nv.edits_for(f)}
        assert set(index.near(a)) == expected


def test_two_swaps_across_borders():
    form = "vellaburypost"
    index = nv.SegmentIndex([(form, 1, 0)])
    swapped = lambda t, i: t[:i] + t[i + 1] + t[i] + t[i + 2 :]
    for i in range(len(form) - 1):
        for j in range(i + 2, len(form) - 1):
            assert index.near(swapped(swapped(form, i), j))


def tied(spark, *typed):
    data = [(i, *t, "clash") for i, t in enumerate(typed)]
    found = rows(nv.tied_names(spark.createDataFrame(data, ROWS), spark.createDataFrame(OUTLETS, "id long, name string, domain string"), spark.createDataFrame(PEOPLE, "contributor_id long, full_name string, outlet_id long")))
    return {(i, f): sorted(e for j, g, e in found if (j, g) == (i, f)) for i, f, _ in found}


def test_outlets(spark):
    names = ["The Vellabury Evening Post", "the vellabury  evening post", "Vellabury Evning Psot", "VEP", "Post, Vellabury", "Vellabury", "TheVellaburyEveningPost", "Diario Tarrecote Online", "Rundschau, Tardagård", "Wesby Courier", "", None, "The Haldarick Courier Ltd"]
    got = tied(spark, *[(n, None, None, None) for n in names])
    assert got == {(1, "outlet_name"): [1], (2, "outlet_name"): [1], (3, "outlet_name"): [1], (4, "outlet_name"): [1], (6, "outlet_name"): [1], (7, "outlet_name"): [3], (8, "outlet_name"): [4], (12, "outlet_name"): [5]}


def test_domains_decide(spark):
    got = tied(spark, ("Vellabury", "VELLABURY-LEDGER.example:443", None, None), ("VEP", None, "https://m.vellaburyeveningpost.example/1", None), ("Harlarick Courier", "hallarickcourier.example", None, None), ("Hollarick Courier", "hollarickcourier.example", None, None))
    assert got == {(0, "outlet_name"): [2], (1, "outlet_name"): [1], (2, "outlet_name"): [6]}


def test_bylines(spark):
    o = "The Vellabury Evening Post"
    typed = ["Søren Drainåd", "DRAINÅD Søren", "Drainåd, Søren", "S. Drainåd", "Drainåd S", "Soren Draniåd", "By Søren Drainåd", "Paco Ulvtugaard", "søren drainåd and Francisco Ulvtugaard", "soren.drainad@x.example", "Søren Drainåd, staff correspondent", "Staff", "Erik Drainåd", "", None]
    got = tied(spark, *[(o, None, None, b) for b in typed])
    assert got == {**{(i, "byline"): [10] for i in (1, 2, 3, 4, 5, 6, 9, 10)}, (7, "byline"): [11], (8, "byline"): [10, 11]}


def test_bylines_belong_to_the_rows_outlet(spark):
    got = tied(spark, (None, "tarrecotediario.example", None, "SØREN DRAINÅD"), ("Vellabury Ledger", None, None, "Soren Drainad"), (None, None, None, "Soren Drainad"), ("The Haldarick Courier", None, None, "A. Berg"))
    assert got == {(0, "byline"): [12]}


def test_short_first_names():
    yes = [("sasha", "alexander"), ("pepe", "jose"), ("vanni", "giovanni"), ("benny", "benjamin"), ("rosie", "rosa"), ("vicky", "victoria"), ("hans", "johannes"), ("lottchen", "lotte"), ("alex", "alexandra"), ("bert", "robert"), ("gosia", "malgorzata")]
    no = [("anna", "anders"), ("petra", "paul"), ("al", "otto"), ("maria", "maria"), ("tom", "robert")]
    assert all(nv.shortens(*x) for x in yes) and not any(nv.shortens(*x) for x in no)


def test_large_registers_are_taken_in_blocks(spark, monkeypatch):
    o = "The Vellabury Evening Post"
    typed = [("VEP", None, None, None), ("Vellabury Evning Psot", None, None, "DRAINÅD Søren"), ("Vellabury", "VELLABURY-LEDGER.example:443", None, "Å. Vellamann"), (o, None, None, "søren drainåd and Francisco Ulvtugaard"), (o, None, None, "Søren Drainåd"), (None, None, None, "x"), ("Rundschau, Tardagård", None, None, None), ("The Haldarick Courier", None, None, "A. Berg"), ("Courier", None, None, None)]
    whole = tied(spark, *typed)
    assert len(whole) == 7
    monkeypatch.setattr(nv, "REGISTER_LIMIT", 3)
    assert tied(spark, *typed) == whole


def test_empty(spark):
    assert nv.tied_names(spark.createDataFrame([], ROWS), spark.createDataFrame(OUTLETS, "id long, name string, domain string"), spark.createDataFrame(PEOPLE, "contributor_id long, full_name string, outlet_id long")).count() == 0
