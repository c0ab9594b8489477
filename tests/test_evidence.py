"""Dates, names and phone regions."""

import pytest
from pyspark.sql import functions as F

from lakeward.functions import addresses as W
from lakeward.functions import dates as D
from lakeward.functions import phones as P
from lakeward.operators import evidence as E


def parsed(spark, texts, read=D.parse_date):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", read(F.col("t")).alias("d")).orderBy("i").collect()
    return [None if r.d is None else (r.d.year, r.d.month, r.d.day, r.d.timed) for r in rows]


def test_dates_in_many_forms(spark):
    same = [
        "1980-05-17", "17/05/1980", "05/17/1980", "17.05.1980", "17-05-1980", "1980/05/17", "1980.05.17", "19800517", "17 May 1980", "17 mai 1980", "May 17, 1980", "May 17th, 1980", "17-May-1980", "17. Mai 1980",
        "17 de mayo de 1980", "Sat, 17 May 1980", "1980-May-17", " 17 maggio 1980 ", "17 MEI 1980", "17 maio 1980", "sam., 17 mai 1980",
    ]
    assert parsed(spark, same) == [(1980, 5, 17, "none")] * len(same)
    others = {"1er janvier 1980": (1980, 1, 1, "none"), "17 févr. 1980": (1980, 2, 17, "none"), "7/4/1980": (1980, 4, 7, "none"), "2004-02-29": (2004, 2, 29, "none"), "1980-05-17T00:00:00Z": (1980, 5, 17, "whole_hour"),
              "1980-05-16T22:30:00.000+02:00": (1980, 5, 16, "other"), "17.05.1980 10:00": (1980, 5, 17, "whole_hour"), "1 août 1944": (1944, 8, 1, "none")}
    assert parsed(spark, list(others)) == list(others.values())
    bad = ["1899-01-01", "2031-01-01", "2003-02-29", "1900-02-29", "1980-13-13", "1980-05/17", "E.164", "17 Foo 1980", "12345678", "", None, "1980", "31/04/1980", "13/13/1980", "17 1980", "2024-05-03 10"]
    assert parsed(spark, bad) == [None] * len(bad)


def test_labelled_birth_dates(spark):
    texts = {"She was born on 17 May 1980 in": (1980, 5, 17, "none"), "Née le 03/02/1975": (1975, 2, 3, "none"), "DOB: 1980-05-17;": (1980, 5, 17, "none"), "geboren am 1. August 1944": (1944, 8, 1, "none"),
             "due 1980-05-17": None, "born free, 17 May 1980": None, "date of birth: unknown": None, None: None}
    assert parsed(spark, list(texts), D.labelled_birth_date) == list(texts.values())


def columns(spark, data):
    return spark.createDataFrame([("t", field, v) for field, values in data.items() for v in values], "object string, field string, value string")


def test_name_columns(spark):
    data = {
        "people": ["Anna Müller", "Dr. Jean Dupré-Martin", "García, María de la", "Paul", "Zbigniew Novak"] * 4, "upper": ["anna", "james"] * 5, "cities": ["Paris", "London", "Berlin"] * 5, "mixed": ["Anna Smith", "a note", "x", "9"],
        "family": ["Smith", "Weber"] * 5, "long": ["Anna Anna Anna Anna Anna Anna"] * 3, "empty": ["", " ", None, ",,"],
    }
    got = {r.field: r for r in E.name_columns(columns(spark, data), E.small_lexicon(spark)).collect()}
    assert {f for f, r in got.items() if r.person_name} == {"people"} and (got["people"].n, got["people"].named, got["people"].given) == (20, 16, 16)
    assert got["empty"].n == 1 and got["empty"].named == 0 and got["cities"].entities == 15 and got["long"].named == 0
    more = E.small_lexicon(spark).unionByName(spark.createDataFrame([("zbigniew", "given"), ("novak", "family")], "word string, kind string"))
    assert E.name_columns(columns(spark, data).where("field = 'people'"), more).first().named == 20


def test_birth_date_columns(spark):
    data = {
        "born": [f"{1940 + i}-0{1 + i % 9}-1{i % 9}" for i in range(60)], "orders": [f"202{i % 5}-03-1{i % 9}" for i in range(60)], "firsts": [f"{1940 + i}-01-01" for i in range(60)],
        "narrow": [f"199{i % 5}-05-1{i}" for i in range(9)], "half": [f"{1940 + i}-05-17" for i in range(20)] + ["x"] * 21, "none": ["a", "b"],
    }
    got = {r.field: (r.birth_date, r.n, r.dated) for r in E.birth_date_columns(columns(spark, data)).collect()}
    assert got == {"born": (True, 60, 60), "orders": (False, 60, 60), "firsts": (False, 60, 60), "narrow": (False, 9, 9), "half": (False, 41, 20), "none": (False, 2, 0)}


def test_numbers_of_one_column_are_dealt(spark):
    """No exchange is keyed by the column alone before its numbers are counted, so no task gets them all."""
    rows = spark.range(400).selectExpr("'t' object", "'p' field", "if(id % 10 = 0, 'x', concat('01 22 33 44 ', lpad(cast(id % 50 as string), 2, '0'))) raw")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        phones = E.regional_phones(rows)
        plan = phones._jdf.queryExecution().executedPlan().toString()
        got = {(r.region, r.grade): (r.n, r.numbers) for r in E.counted_numbers(phones).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Broadcast" in next(line for line in plan.split("\n") if "Join" in line)  # the join with the numbers, which is the uppermost
    forms = phones.groupBy("region", "grade").agg(F.count("*").alias("n"), F.count_distinct("e164").alias("d")).collect()
    assert got == {(r.region, r.grade): (r.n, r.d) for r in forms} and sum(n for n, _ in got.values()) == 400


def test_phone_regions(spark):
    data = {
        "fr": ["01 99 00 27 59"] * 6 + ["+33 1 99 00 27 59"] * 2 + ["0199002759"], "iberia": ["912 345 678"] * 5, "pt": ["912 345 678"] * 5 + ["+351 912 345 678"], "us": ["(202) 555-0125", "202-555-0125"], "mixed": ["+33 1 99 00 27 59", "+49 30 123456", "+1 202 555 0125"],
    }
    rows = columns(spark, data).withColumnRenamed("value", "raw")
    assert {r.field: r.region for r in E.phone_regions(rows).collect()} == {"fr": "FR", "iberia": None, "pt": "PT", "us": "US", "mixed": None}
    got = E.regional_phones(rows).collect()
    assert {r.e164 for r in got if r.field == "fr"} == {"33199002759"} and {r.e164 for r in got if r.field == "pt"} == {"351912345678"} and {r.e164 for r in got if r.field == "us"} == {"12025550125"}
    assert {(r.raw, r.grade) for r in got if r.field == "fr"} == {("01 99 00 27 59", 3), ("+33 1 99 00 27 59", 3), ("0199002759", None)}
    assert {r.e164 for r in got if r.field == "iberia"} == {None} and {r.grade for r in got if r.field == "mixed"} == {3}


@pytest.mark.parametrize(("value", "region", "number"), [("+44 (0)20 7946 0958", None, "442079460958"), ("020 7946 0958", "GB", "442079460958"), ("0049 30 123456", "FR", "4930123456"), ("347 123 4567", "IT", "393471234567"), ("347 123 4567", None, None)])
def test_e164(spark, value, region, number):
    row = spark.createDataFrame([(value, region)], "v string, r string")
    assert row.select(P.e164(F.col("v"), F.col("r"))).first()[0] == number


def test_addresses(spark):
    strong = [
        "221b Baker Street, London", "12 rue de la Paix", "12 bis, avenue Victor Hugo 75001 Paris", "Hauptstraße 5", "Unter-den-Linden-Allee 7a", "Calle Mayor 12", "Via Roma, 3", "PO Box 1234", "P.O. Box 12", "Postfach 33", "1600 Pennsylvania Ave NW",
        "BP 12", "ship to 10 Downing Street please", "Dorpsstraat 12", "rua das Flores n° 5",
    ]
    weak, none = ["75001 Paris", "10115 Berlin", "SW1A 2AA London", "1012 AB Amsterdam"], ["", "Street", "12 apples", "the way to go", "room 12", "75001", "version 3 of the test", "12345 items", None, "best 5", "A1 road"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(strong + weak + none)], "i int, t string")
    got = [r.s for r in rows.select("i", W.address_strength(F.col("t")).alias("s")).orderBy("i").collect()]
    assert got == ["strong"] * len(strong) + ["weak"] * len(weak) + [None] * len(none)


def test_address_columns(spark):
    data = {"home": ["12 rue de la Paix"] * 3 + ["x"] * 2, "mixed": ["12 rue de la Paix"] * 2 + ["75001 Paris"] * 5, "towns": ["75001 Paris"] * 5, "notes": ["sent to 10 Downing Street"] * 3 + ["a"] * 20, "few": ["10 Downing Street"] * 2 + ["a"] * 9}
    assert {r.field: r.postal_address for r in E.address_columns(columns(spark, data)).collect()} == {"home": True, "mixed": True, "towns": False, "notes": True, "few": False}
