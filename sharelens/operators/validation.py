"""Census and election tables compared with communities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharelens.functions.numeric import percent_difference
from sharelens.session import settle_small

# Community to occupation labels.
OCCUPATIONS = {
    "Firefighting": ["Firefighters"],
    "civilengineering": ["Civil engineers"],
    "Construction": ["Construction laborers"],
    "metalworking": ["Sheet metal workers", "Other metal workers and plastic workers"],
    "Carpentry": ["Carpenters"],
    "electricians": ["Electricians"],
    "Plumbing": ["Plumbers, pipefitters, and steamfitters"],
    "Truckers": ["Driver/sales workers and truck drivers"],
    "mechanics": ["Automotive service technicians and mechanics"],
    "farming": ["Farmers, ranchers, and other agricultural managers"],
    "humanresources": ["Human resources workers"],
    "teaching": ["Elementary and middle school teachers", "Secondary school teachers"],
    "ECEProfessionals": ["Preschool and kindergarten teachers"],
    "nursing": ["Registered nurses"],
    "Dentistry": ["Dentists", "Dental hygienists", "Dental assistants"],
    "psychotherapy": ["Marriage and family therapists", "Therapists, all other"],
    "specialed": ["Special education teachers"],
    "socialwork": [
        "Child, family, and school social workers",
        "Mental health and substance abuse social workers",
        "Social workers, all other",
    ],
    "Nanny": ["Childcare workers"],
    "optometry": ["Optometrists"],
    "pharmacy": ["Pharmacists", "Pharmacy aides"],
    "librarians": ["Librarians and media collections specialists"],
    "Professors": ["Postsecondary teachers"],
}
ELECTION_YEARS = [2008, 2012, 2016]


def occupation_map(spark) -> DataFrame:
    return spark.createDataFrame(list(OCCUPATIONS.items()), "community string, occ array<string>")


def fips(state: Column, county: Column) -> Column:
    """State and county codes as one number: two and three digits."""
    return F.format_string("%02d%03d", state.cast("int"), county.cast("int")).cast("int")


def metro_name(title: Column) -> Column:
    return F.concat(title, F.lit(" Metro Area"))


def map_places(df: DataFrame, places: DataFrame, label: str = "label") -> DataFrame:
    """Community of each place name; unmapped places get an empty name."""
    mapping = settle_small(places.select(F.col("place").alias(label), "community"))
    return df.join(mapping, label, "left").withColumn("community", F.coalesce("community", F.lit("")))


def flag_valid(df: DataFrame, vectors: DataFrame) -> DataFrame:
    """``valid``: the community has a vector."""
    known = vectors.select(F.col("id").alias("community"), F.lit(True).alias("valid"))
    return df.join(known, "community", "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def income_by_metro(
    income: DataFrame, places: DataFrame, vectors: DataFrame, include_invalid: bool = False
) -> DataFrame:
    """``community, label, y``: income of mapped metro areas, lowest first.

    ``income`` has the census columns ``GEO.display-label`` and ``HD01_VD01``.
    """
    table = income.select(
        F.col("`GEO.display-label`").alias("label"), F.col("HD01_VD01").alias("income")
    ).where(F.col("label") != "Geography")
    table = flag_valid(map_places(table, places), vectors)
    if not include_invalid:
        table = table.where("valid")
    return table.select("community", "label", F.expr("try_cast(income as double)").alias("y")).orderBy("y", "label")


def metro_counties(counties: DataFrame, places: DataFrame) -> DataFrame:
    """``metro, FIPS, county_name`` of counties in mapped metropolitan areas."""
    metro = counties.where(
        F.col("`Metropolitan/Micropolitan Statistical Area`") == "Metropolitan Statistical Area"
    ).select(
        metro_name(F.col("CBSA Title")).alias("metro"),
        fips(F.col("FIPS State Code"), F.col("FIPS County Code")).alias("FIPS"),
        F.col("`County/County Equivalent`").alias("county_name"),
    )
    return metro.join(settle_small(places.select(F.col("place").alias("metro"))), "metro", "left_semi")


def county_results(election: DataFrame) -> DataFrame:
    """One row per county and year: votes of both parties and in total."""
    rows = election.where(F.col("FIPS").isNotNull() & ~F.isnan(F.col("FIPS").cast("double")))
    party_votes = [
        F.max(F.when(F.col("party") == party, F.col("candidatevotes"))).alias(name)
        for party, name in (("democrat", "votes_dem"), ("republican", "votes_rep"))
    ]
    return rows.groupBy(F.col("FIPS").cast("int").alias("FIPS"), "year").agg(
        F.min("state").alias("state"),
        F.min("county").alias("county"),
        *party_votes,
        F.max("totalvotes").alias("votes_total"),
    )


def election_by_metro(
    election: DataFrame, metros: DataFrame, places: DataFrame, years: list[int] | None = None
) -> DataFrame:
    """``year, community, label, votes..., y``: lead of the second party in percent."""
    counties = county_results(election).where(F.col("year").isin(years or ELECTION_YEARS))
    joined = counties.join(metros.select("FIPS", "metro"), "FIPS")
    votes = ["votes_dem", "votes_rep", "votes_total"]
    summed = joined.groupBy("year", "metro").agg(*[F.sum(v).alias(v) for v in votes])
    named = summed.join(places.select(F.col("place").alias("metro"), "community"), "metro")
    y = percent_difference(F.col("votes_rep"), F.col("votes_dem"), F.col("votes_total"))
    return named.select("year", "community", F.col("metro").alias("label"), *votes, y.alias("y"))


def occupation_values(table: DataFrame) -> DataFrame:
    """``occupation, value`` from transposed ``label, value`` rows (``Estimate!!Total!!name``)."""
    parts = F.split("label", "!!")
    return table.where(F.get(parts, F.lit(0)) == "Estimate").select(
        F.get(parts, F.lit(2)).alias("occupation"),
        F.expr("try_cast(value as bigint)").alias("value"),
    )


def occupation_shares(female: DataFrame, male: DataFrame) -> DataFrame:
    """Women, men and the share of women per occupation, lowest share first."""
    f = occupation_values(female).withColumnRenamed("value", "value_f")
    m = occupation_values(male).withColumnRenamed("value", "value_m")
    total = F.col("value_f") + F.col("value_m")
    joined = f.join(m, "occupation", "left").withColumn("pct_f", F.try_divide(F.col("value_f"), total))
    return joined.orderBy("pct_f", "occupation")


def occupations_by_community(shares: DataFrame, mapping: DataFrame) -> DataFrame:
    """``community, occ, value_f, value_m, y`` over the occupations of each community."""
    listed = mapping.select("community", F.posexplode("occ").alias("ord", "occupation"))
    joined = listed.join(shares.select("occupation", "value_f", "value_m"), "occupation", "left")
    per = joined.groupBy("community").agg(
        F.array_sort(F.collect_list(F.struct("ord", "occupation"))).alias("occ"),
        F.sum("value_f").alias("value_f"),
        F.sum("value_m").alias("value_m"),
    )
    y = F.try_divide(F.col("value_f"), F.col("value_f") + F.col("value_m"))
    return per.select(
        "community", F.transform("occ", lambda o: o["occupation"]).alias("occ"), "value_f", "value_m", y.alias("y")
    )


def all_validations(income: DataFrame, elections: DataFrame, occupations: DataFrame) -> DataFrame:
    """All comparisons in long form ``validation, community, label, y``."""
    columns = ["validation", "community", "label", "y"]
    parts = [
        income.withColumn("validation", F.lit("uscensus_income")),
        elections.withColumn("validation", F.concat(F.lit("us_election_"), F.col("year").cast("string"))),
        occupations.withColumn("validation", F.lit("us_census_occupations")).withColumn(
            "label", F.array_join("occ", "; ")
        ),
    ]
    out = parts[0].select(columns)
    for part in parts[1:]:
        out = out.unionByName(part.select(columns))
    return out
