"""Every registered query outside the corpus operators against its SQL, and the contract of the entry file."""

import random
import re
from difflib import SequenceMatcher

import pytest

import __spark_entry__
from lontar.operators import fuzzy
from lontar.operators.assess import STNK_REQUIRED
from lontar.plans.catalogue import QUERIES, SQL
from lontar.plans.vehicle_registration import LABELS

from .compare import database, same


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf_dir, con, name):
    same(QUERIES[name](spark, sf_dir), con, SQL[name])


def test_every_other_query_has_sql():
    assert set(QUERIES) - set(SQL) == {"fuzzy_label"}


def plain_score(text: str) -> tuple[float, float, float]:
    """Coverage of required and of other labels, and the marker score, by trying every beginning of every line."""
    plain = lambda v: "".join(c for c in v.upper().translate(str.maketrans("0158", "OISB")) if c.isalnum())

    def ratio(x: str, y: str) -> float:
        a, b = plain(x), plain(y)
        if not a or not b:
            return 0.0
        found = SequenceMatcher(None, a, b).ratio()
        short, long = sorted((len(a), len(b)))
        return max(found, min(1.0, short / long + 0.05)) if a.startswith(b) or (b.startswith(a) and short >= 0.7 * len(b)) else found

    covered = set()
    for line in re.split("[\r\n]", text or ""):
        line = " ".join(line.split()).strip(" :;").strip(" :.-")
        scored = []
        for field, names in LABELS.items():
            for name in names:
                least = {True: 0.9, False: 0.84 if len(plain(name)) <= 9 else 0.78}[len(plain(name)) <= 6]
                ends = {*range(max(3, int(0.65 * len(name))), min(len(line), max(len(name) + 8, int(1.45 * len(name)), line.find(":"))) + 1), min(len(line), len(name)), *(line.find(c) for c in ":-/\\")}
                scored += [(score, end, field) for end in ends if end > 0 and len(line) >= 3 and (score := ratio(line[:end], name)) >= least]
        if scored:
            best = max(scored, key=lambda x: x[:2])
            if round(best[0], 3) >= 0.78:
                covered.add(best[2])
    flat = re.sub("[^A-Z]", "", (text or "").upper().translate(str.maketrans("0158", "OISB")))
    marks = 1.0 if any(t in flat for t in ("SURATTANDANOMORKENDARAAN", "NOMORKENDARAANBERMOTOR")) else min(1.0, sum(m in flat for m in ("STNK", "SAMSAT", "TNKB", "BPKB", "SWDKLLJ", "BBNKB")) / 3)
    other = set(LABELS) - set(STNK_REQUIRED)
    return len(covered & set(STNK_REQUIRED)) / len(STNK_REQUIRED), len(covered & other) / len(other), marks


def test_fuzzy_labels_against_every_beginning(spark):
    rnd = random.Random(6)
    lines = [n for names in LABELS.values() for n in names] + ["SAMSAT", "BPKB STNK", "some other words", "B 1234 XYZ", "TOYOTA"]
    rows = [(0, None), (1, ""), (2, "SURAT TANDA NOMOR KENDARAAN BERMOTOR\nN0 P0LISI : B 1 X")]
    for i in range(3, 40):
        made = []
        for _ in range(rnd.randrange(1, 6)):
            line = list(rnd.choice(lines) + rnd.choice(["", " : value", " - x", ": 12/34"]))
            for _ in range(rnd.randrange(3)):
                line[rnd.randrange(len(line))] = rnd.choice("XO015 ")
            made.append("".join(line))
        rows.append((i, "\n".join(made)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in fuzzy.structure_score(docs, LABELS, STNK_REQUIRED).collect():
        want = plain_score(dict(rows)[r["doc_id"]])
        assert (r["required_coverage"], r["optional_coverage"], r["marker_score"]) == pytest.approx(want, abs=0.0006), dict(rows)[r["doc_id"]]
        assert r["score"] == pytest.approx(min(1.0, 0.65 * want[0] + 0.2 * want[1] + 0.15 * want[2]), abs=0.0011)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["source", "n_ids", "n_distinct", "n_docs"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
