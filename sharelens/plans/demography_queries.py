"""Comparisons with census and election tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sharelens.operators import validation as ops
from sharelens.plans.registry import query
from sharelens.plans.views import Views, rounded

YEARS = [1996, 1998, 2000]


def income_of(v: Views):
    return ops.income_by_metro(v.income(), v.places(), v.vectors())


def election_of(v: Views):
    metros = ops.metro_counties(v.counties(), v.places())
    return ops.election_by_metro(v.election(), metros, v.places(), YEARS)


def occupation_of(v: Views):
    shares = ops.occupation_shares(v.occupation(0), v.occupation(1))
    return ops.occupations_by_community(shares, v.occupation_map())


@query("income_map", "SELECT community, label, y FROM income_map_v")
def income_map(v: Views):
    return income_of(v)


@query(
    "income_map_all",
    """
    SELECT coalesce(p.community, '') AS community, i.label, i.income AS y FROM income_v i
    LEFT JOIN places_v p ON p.place = i.label""",
)
def income_map_all(v: Views):
    return ops.income_by_metro(v.income(), v.places(), v.vectors(), include_invalid=True)


@query(
    "metro_counties",
    """
    SELECT n_name || ' Metro Area' AS metro, CAST(s_suppkey AS INTEGER) AS "FIPS", 'county ' || s_suppkey AS county_name
    FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN places_v ON place = n_name || ' Metro Area'
    WHERE s_suppkey % 13 <> 0""",
)
def metro_counties(v: Views):
    return ops.metro_counties(v.counties(), v.places())


@query(
    "county_results",
    """
    SELECT CAST(l_suppkey AS INTEGER) AS "FIPS", year(l_shipdate) AS year, 'S' AS state, 'county ' || l_suppkey AS county,
           CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS INTEGER) END) AS BIGINT) AS votes_dem,
           CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS INTEGER) END) AS BIGINT) AS votes_rep,
           CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS votes_total FROM lineitem GROUP BY l_suppkey, 2""",
)
def county_results(v: Views):
    return ops.county_results(v.election())


@query(
    "election_diff",
    "SELECT year, community, label, votes_dem, votes_rep, votes_total, round(y, 6) + 0.0 AS y FROM election_v",
)
def election_diff(v: Views):
    return rounded(election_of(v), "y")


@query("occupation_share", "SELECT community, label, value_f, value_m, round(y, 6) AS y FROM occupation_share_v")
def occupation_share(v: Views):
    rows = occupation_of(v).withColumn("label", F.array_join("occ", "; ")).drop("occ")
    return rounded(rows.select("community", "label", "value_f", "value_m", "y"), "y")


@query(
    "validations",
    """
    SELECT 'uscensus_income' AS validation, community, label, round(y, 6) + 0.0 AS y FROM income_map_v
    UNION ALL SELECT 'us_election_' || year, community, label, round(y, 6) + 0.0 FROM election_v
    UNION ALL SELECT 'us_census_occupations', community, label, round(y, 6) + 0.0 FROM occupation_share_v""",
)
def validations(v: Views):
    return rounded(ops.all_validations(income_of(v), election_of(v), occupation_of(v)), "y")
