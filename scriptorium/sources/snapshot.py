"""Nested work records (JSON snapshots): flattening and selection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Shape of a nested work record.
WORK_SCHEMA = """
id string, doi string, title string, display_name string, publication_year int, publication_date string,
type string, cited_by_count long, language string,
open_access struct<is_oa:boolean,oa_status:string>,
authorships array<struct<author:struct<id:string,display_name:string,orcid:string>,
  institutions:array<struct<id:string,display_name:string,country_code:string>>,countries:array<string>>>,
primary_location struct<source:struct<display_name:string,issn_l:string>>,
concepts array<struct<display_name:string>>, topics array<struct<display_name:string>>,
keywords array<struct<display_name:string,keyword:string>>,
sustainable_development_goals array<struct<display_name:string>>,
referenced_works array<string>, abstract_inverted_index map<string,array<int>>
"""

# Country codes and names.
COUNTRY_NAMES = {
    "US": "United States", "GB": "United Kingdom", "DE": "Germany", "FR": "France", "IT": "Italy",
    "ES": "Spain", "NL": "Netherlands", "BE": "Belgium", "AT": "Austria", "CH": "Switzerland",
    "SE": "Sweden", "NO": "Norway", "DK": "Denmark", "FI": "Finland", "PL": "Poland",
    "CZ": "Czech Republic", "HU": "Hungary", "PT": "Portugal", "GR": "Greece", "IE": "Ireland",
    "RO": "Romania", "BG": "Bulgaria", "HR": "Croatia", "SI": "Slovenia", "SK": "Slovakia",
    "LT": "Lithuania", "LV": "Latvia", "EE": "Estonia", "CY": "Cyprus", "LU": "Luxembourg", "MT": "Malta",
    "CN": "China", "JP": "Japan", "KR": "South Korea", "IN": "India", "AU": "Australia",
    "NZ": "New Zealand", "CA": "Canada", "MX": "Mexico", "BR": "Brazil", "AR": "Argentina", "CL": "Chile",
    "CO": "Colombia", "RU": "Russia", "UA": "Ukraine", "TR": "Turkey", "IL": "Israel",
    "SA": "Saudi Arabia", "AE": "United Arab Emirates", "EG": "Egypt", "ZA": "South Africa",
    "NG": "Nigeria", "KE": "Kenya", "MA": "Morocco", "TW": "Taiwan", "HK": "Hong Kong",
    "SG": "Singapore", "MY": "Malaysia", "TH": "Thailand", "ID": "Indonesia", "PH": "Philippines",
    "VN": "Vietnam", "PK": "Pakistan", "BD": "Bangladesh", "IR": "Iran", "IQ": "Iraq",
}
# Further spellings accepted as they are.
COUNTRY_SPELLINGS = ("USA", "UK", "England", "Scotland", "Wales", "Peru", "Venezuela")

ISSN = re.compile(r"(\d{4})-?(\d{3}[\dXx])")


def read_works(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines snapshot with an explicit schema (no inference pass over the data)."""
    return spark.read.schema(WORK_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def named(items: Column, field: str = "display_name") -> Column:
    """The non-empty names of an array of structs, never null."""
    names = F.filter(F.transform(items, lambda x: x[field]), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(names, F.array().cast("array<string>"))


def abstract_text(index: Column) -> Column:
    """Text from a word -> positions map."""
    placed = F.flatten(
        F.transform(
            F.map_entries(index),
            lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w"))),
        )
    )
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " ")


def country_name(code: Column, names: dict[str, str] | None = None) -> Column:
    """Name of a code; unknown codes pass through (a literal map: the table has a fixed small size)."""
    table = names or COUNTRY_NAMES
    lookup = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return F.coalesce(F.try_element_at(lookup, code), code)


def flatten_works(works: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Nested records to the canonical works table (no shuffle: every step is inside the row)."""
    a = F.coalesce(F.col("authorships"), F.array().cast(works.schema["authorships"].dataType))
    authors = F.filter(F.transform(a, lambda x: x["author"]["display_name"]), lambda x: x.isNotNull() & (x != ""))
    author_ids = F.filter(F.transform(a, lambda x: x["author"]["id"]), lambda x: x.isNotNull() & (x != ""))
    insts = F.flatten(F.filter(F.transform(a, lambda x: x["institutions"]), lambda x: x.isNotNull()))
    codes = F.array_union(
        F.filter(F.transform(insts, lambda i: i["country_code"]), lambda c: c.isNotNull() & (c != "")),
        F.flatten(F.filter(F.transform(a, lambda x: x["countries"]), lambda x: x.isNotNull())),
    )
    concepts = F.slice(named(F.slice("concepts", 1, 10)), 1, 10)
    topics = named(F.slice("topics", 1, 5))
    words = F.coalesce(
        F.filter(
            F.transform("keywords", lambda k: F.coalesce(F.nullif(k["display_name"], F.lit("")), k["keyword"])),
            lambda k: k.isNotNull() & (k != ""),
        ),
        F.array().cast("array<string>"),
    )
    refs = F.coalesce("referenced_works", F.array().cast("array<string>"))
    return works.select(
        F.col("id").alias("doc_id"),
        "doi",
        F.coalesce("title", "display_name").alias("title"),
        F.col("publication_year").alias("year"),
        "publication_date",
        F.col("type").alias("doc_type"),
        F.coalesce("cited_by_count", F.lit(0)).cast("long").alias("cited_by"),
        F.coalesce("open_access.is_oa", F.lit(False)).alias("is_oa"),
        F.col("open_access.oa_status").alias("oa_status"),
        authors.alias("authors"),
        author_ids.alias("author_ids"),
        F.size(authors).alias("authors_count"),
        F.array_sort(F.array_distinct(named(insts))).alias("affiliations"),
        F.array_sort(F.transform(codes, lambda c: country_name(c, names))).alias("countries"),
        F.array_sort(F.array_distinct(F.concat(words, concepts, topics))).alias("author_keywords"),
        concepts.alias("index_keywords"),
        topics.alias("subject_areas"),
        named(F.col("sustainable_development_goals")).alias("sdgs"),
        F.col("primary_location.source.display_name").alias("source"),
        F.col("primary_location.source.issn_l").alias("issn"),
        F.coalesce(abstract_text(F.col("abstract_inverted_index")), F.lit("")).alias("abstract"),
        refs.alias("references"),
        F.size(refs).alias("references_count"),
    )


def select_works(
    works: DataFrame,
    year_from: int | None = None,
    year_to: int | None = None,
    doc_type: str | None = None,
    open_access: bool = False,
    author: str | None = None,
    institution: str | None = None,
    journal: str | None = None,
    dois: DataFrame | list[str] | None = None,
    keywords: str | None = None,
) -> DataFrame:
    """Filters of a snapshot search on nested records; scalar ones reach the parquet scan.

    ``author`` is an ORCID (``0000-…``) or part of a name; ``journal`` an ISSN or part of a name;
    ``keywords`` must all occur in the title, the abstract or the keyword names.
    """
    out = works
    if year_from is not None:
        out = out.filter(F.col("publication_year") >= year_from)
    if year_to is not None:
        out = out.filter(F.col("publication_year") <= year_to)
    if doc_type:
        out = out.filter(F.col("type") == doc_type)
    if open_access:
        out = out.filter(F.col("open_access.is_oa"))
    if author and "0000-" in author:
        out = out.filter(F.exists("authorships", lambda a: a["author"]["orcid"].contains(author.strip())))
    elif author:
        part = author.lower()
        out = out.filter(F.exists("authorships", lambda a: F.lower(a["author"]["display_name"]).contains(part)))
    if institution:
        part = institution.lower()
        out = out.filter(
            F.exists(
                "authorships",
                lambda a: F.exists(a["institutions"], lambda i: F.lower(i["display_name"]).contains(part)),
            )
        )
    issn = ISSN.fullmatch(journal.strip()) if journal else None
    if issn:
        out = out.filter(F.upper(F.replace("primary_location.source.issn_l", F.lit("-"), F.lit(""))) == "".join(issn.groups()).upper())
    elif journal:
        out = out.filter(F.lower("primary_location.source.display_name").contains(journal.lower()))
    if isinstance(dois, list):
        out = out.filter(F.col("doi").isin(*dois))
    elif dois is not None:
        out = out.join(dois.select("doi").distinct(), "doi", "left_semi")
    if keywords:
        # words of the inverted index are enough to search an abstract; the text is never rebuilt
        fields = F.array_join(
            F.concat(
                F.array(F.coalesce("title", F.lit(""))),
                F.coalesce(F.map_keys("abstract_inverted_index"), F.array().cast("array<string>")),
                named(F.col("keywords")),
            ),
            " ",
        )
        for word in keywords.lower().split():
            out = out.filter(F.lower(fields).contains(word))
    return out


def countries_from_affiliations(
    df: DataFrame, col: str = "affiliations", names: dict[str, str] | None = None, out: str = "countries"
) -> DataFrame:
    """Country of each affiliation: the part after its last comma, if it is a known name or code."""
    table = names or COUNTRY_NAMES
    entries = F.col(col) if df.schema[col].dataType.typeName() == "array" else F.split(col, ";")
    last = F.transform(
        F.filter(entries, lambda e: e.contains(",")),
        lambda e: F.regexp_replace(F.trim(F.element_at(F.split(e, ","), -1)), r"\.+$", ""),
    )
    valid = sorted(set(table.values()) | set(COUNTRY_SPELLINGS))
    lookup = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    found = F.transform(last, lambda c: F.when(c.isin(*valid), c).otherwise(F.try_element_at(lookup, F.upper(c))))
    return df.withColumn(out, F.array_sort(F.array_distinct(F.filter(found, lambda c: c.isNotNull()))))
