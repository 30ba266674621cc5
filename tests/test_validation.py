import pytest

from sharelens.operators import validation as ops
from sharelens.sources import files

PLACES = [("Toronto, ON Metro Area", "toronto"), ("Boston, MA Metro Area", "boston")]


def places(spark):
    return spark.createDataFrame(PLACES, "place string, community string")


def test_income(spark):
    rows = [("Geography", "Estimate"), (PLACES[0][0], "500"), (PLACES[1][0], "100"), ("Elsewhere", "(X)")]
    income = spark.createDataFrame(rows, "`GEO.display-label` string, HD01_VD01 string")
    vectors = spark.createDataFrame([("toronto",)], "id string")
    assert [(r.community, r.y) for r in ops.income_by_metro(income, places(spark), vectors).collect()] == [("toronto", 500.0)]
    every = ops.income_by_metro(income, places(spark), vectors, include_invalid=True).collect()
    assert [(r.community, r.y) for r in every] == [("", None), ("boston", 100.0), ("toronto", 500.0)]


def test_election(spark):
    counties = spark.createDataFrame(
        [
            ("Boston, MA", "Metropolitan Statistical Area", "Suffolk", 25, 25),
            ("Boston, MA", "Metropolitan Statistical Area", "Essex", 25, 9),
            ("Boston, MA", "Micropolitan Statistical Area", "No", 1, 1),
            ("Nowhere", "Metropolitan Statistical Area", "No", 2, 2),
        ],
        "`CBSA Title` string, `Metropolitan/Micropolitan Statistical Area` string, "
        "`County/County Equivalent` string, `FIPS State Code` int, `FIPS County Code` int",
    )
    metros = ops.metro_counties(counties, places(spark))
    assert {r.FIPS for r in metros.collect()} == {25025, 25009}
    votes = [
        (25025.0, 2016, "democrat", 60, 100), (25025.0, 2016, "republican", 40, 100),
        (25009.0, 2016, "democrat", 10, 100), (25009.0, 2016, "republican", 30, 100),
        (25009.0, 2010, "democrat", 10, 100), (float("nan"), 2016, "democrat", 999, 999), (None, 2016, "democrat", 999, 999),
    ]
    election = spark.createDataFrame(
        [(*v, "MA", "c") for v in votes],
        "FIPS double, year int, party string, candidatevotes int, totalvotes int, state string, county string",
    )
    per_county = {(r.FIPS, r.year): (r.votes_dem, r.votes_rep) for r in ops.county_results(election).collect()}
    assert per_county == {(25025, 2016): (60, 40), (25009, 2016): (10, 30), (25009, 2010): (10, None)}
    row = ops.election_by_metro(election, metros, places(spark)).collect()
    assert [(r.year, r.community, r.votes_dem, r.votes_total, r.y) for r in row] == [(2016, "boston", 70, 200, 0.0)]


def test_occupations(spark, tmp_path):
    path = str(tmp_path / "acs.csv")
    with open(path, "w", encoding="ISO-8859-1") as f:
        f.write("GEO,A,B,C\n")
        f.write('id,Estimate!!Total!!Dentists,"Estimate!!Total!!Nurses, RN",Margin!!Total!!Dentists\n')
        f.write("us,30,70,5\n")
    female = files.read_transposed(spark, path, ["GEO", "A", "B", "C"], "ISO-8859-1")
    male = spark.createDataFrame([("Estimate!!Total!!Dentists", "70"), ("Estimate!!Total!!Nurses, RN", "30")], "label string, value string")
    shares = ops.occupation_shares(female, male)
    assert [(r.occupation, r.pct_f) for r in shares.collect()] == [("Dentists", 0.3), ("Nurses, RN", 0.7)]
    mapping = spark.createDataFrame([("med", ["Nurses, RN", "Dentists"]), ("none", ["Other"])], "community string, occ array<string>")
    found = {r.community: r for r in ops.occupations_by_community(shares, mapping).collect()}
    assert found["med"].occ == ["Nurses, RN", "Dentists"] and found["med"].y == 0.5 and found["none"].y is None


def test_default_occupation_map(spark):
    table = {r.community: r.occ for r in ops.occupation_map(spark).collect()}
    assert len(table) == 23 and table["Dentistry"] == ["Dentists", "Dental hygienists", "Dental assistants"]


def test_validations_in_long_form(spark):
    income = spark.createDataFrame([("a", "A", 1.0)], "community string, label string, y double")
    election = spark.createDataFrame([(2016, "b", "B", -20.0)], "year int, community string, label string, y double")
    occupation = spark.createDataFrame([("c", ["x", "y"], 0.5)], "community string, occ array<string>, y double")
    rows = {tuple(r) for r in ops.all_validations(income, election, occupation).collect()}
    assert rows == {("uscensus_income", "a", "A", 1.0), ("us_election_2016", "b", "B", -20.0), ("us_census_occupations", "c", "x; y", 0.5)}


def test_header_below_the_first_line(spark, tmp_path):
    path = tmp_path / "msa.csv"
    path.write_bytes("List 1,,\n\"Area, title\",,\nTitle,State,County\nPeñasco,01,003\nB,2,4\n".encode("ISO-8859-1"))
    rows = files.read_csv_below(spark, str(path), ["t", "s", "c"], 2, "ISO-8859-1").collect()
    assert [tuple(r) for r in rows] == [("Peñasco", "01", "003"), ("B", "2", "4")]
    code = spark.createDataFrame([("01", "003")], "s string, c string").select(ops.fips(*map(__import__("pyspark.sql.functions", fromlist=["col"]).col, "sc")))
    assert code.first()[0] == pytest.approx(1003)
