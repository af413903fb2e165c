"""Provisions of statutes: hand-written expected lists."""

import pytest

from quern.functions.provisions import statute_references

IPC, CRPC, CPC, COI = "Indian Penal Code", "Code of Criminal Procedure", "Code of Civil Procedure", "Constitution of India"
CASES = {
    "Section 302 IPC": [(IPC, "Section 302")],
    "under Sections 302, 304 and 307 of the Indian Penal Code": [("Indian Penal Code", f"Section {n}") for n in (302, 304, 307)],
    "Section 302 read with Section 34 IPC.": [(IPC, "Section 302"), (IPC, "Section 34")],
    "u/s 498A r/w 34 I.P.C. and s. 482 Cr.P.C.": [(IPC, "Section 498A"), (IPC, "Section 34"), (CRPC, "Section 482")],
    "Sections 3 to 6 of the Arms Act, 1959": [("Arms Act", f"Section {n}") for n in (3, 4, 5, 6)],
    "Sections 10-90 IPC": [(IPC, "Section 10"), (IPC, "Section 90")],
    "Article 21 of the Constitution; Articles 14 and 19(1)(a); Article 500": [(COI, "Article 21"), (COI, "Article 14"), (COI, "Article 19(1)(a)"), (None, "Article 500")],
    "Article 21 read with Article 14 of the Constitution of India": [(COI, "Article 21"), (COI, "Article 14")],
    "Order 39 Rules 1 and 2 CPC": [(CPC, "Order 39 Rule 1"), (CPC, "Order 39 Rule 2")],
    "Order VII Rule 11 bars it": [(CPC, "Order VII Rule 11")],
    "Rule 5 of the Motor Vehicles Rules": [("Motor Vehicles Rules", "Rule 5")],
    "Regulation 3 of the SEBI Takeover Regulations and Clause 49 of the Listing Agreement": [("SEBI Takeover Regulations", "Regulation 3"), ("Listing Agreement", "Clause 49")],
    "Section 5 of the Act": [(None, "Section 5")],
    "Section 302 IPC, again Section 302 IPC": [(IPC, "Section 302")],
    "the section was read; in order to rule": [],
    "write to r.23@mail3.example.com or s.4.x@example.org": [], "mehr für. V und Zé.\n r. I": [(None, "Rule I")],
    "": [], None: [],
}


@pytest.mark.parametrize("text", CASES)
def test_expected(spark, text):
    found = spark.createDataFrame([(text,)], "t string").select(statute_references("t").alias("r")).first().r
    assert [tuple(x) for x in found] == CASES[text]


def test_long_text(spark):
    text = "no such thing here. " * 20_000 + "Section 7 IPC " + "x " * 50_000
    found = spark.createDataFrame([(text,)], "t string").select(statute_references("t").alias("r")).first().r
    assert [tuple(x) for x in found] == [(IPC, "Section 7")]


@pytest.mark.parametrize("text", ["SECIÓNGAARIE!! CIÓN", "ARTICLEIN, ARTIÓN XL", "un s. La, el sec. Ist", "fu\u0308r. 5", "S. 10.21.32.4 y r. 192.168.0.1"])
def test_no_reference_in_words_or_addresses(spark, text):
    found = spark.createDataFrame([(text,)], "t string").select(statute_references("t").alias("r")).first().r
    assert not found


def test_numbers_end_with_their_words(spark):
    text = "s.IV IPC, Section 5, Les Articles XL"
    found = spark.createDataFrame([(text,)], "t string").select(statute_references("t").alias("r")).first().r
    assert [tuple(x) for x in found] == [(IPC, "Section IV"), (None, "Section 5"), (None, "Article XL")]
