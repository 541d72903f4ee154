"""Canonical schema of a collection of works, and the mapping of export dialects onto it.

One row per work::

    doc_id, title, abstract, year int, source, doc_type, cited_by long, is_oa boolean, language, doi,
    authors, author_keywords, index_keywords, affiliations, countries, references,
    subject_areas, sponsors  (array<string>)

``harmonize`` maps whatever columns an export has onto these names, so operators use fixed names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.lists import as_items
from .functions.numeric import to_number


@dataclass(frozen=True)
class Entity:
    """One countable field: canonical column, kind (single, list, text) and known export names."""

    column: str
    kind: str
    label: str
    aliases: tuple[str, ...]


# The column names that known export formats use for each field.
ENTITIES: dict[str, Entity] = {
    "sources": Entity("source", "single", "Source", ("Source title", "Source", "Journal", "source", "SO")),
    "authors": Entity("authors", "list", "Author", ("Authors", "Author", "authors", "AU")),
    "author_keywords": Entity(
        "author_keywords", "list", "Keyword",
        ("Author Keywords", "Author keywords", "author_keywords", "DE", "Keywords"),
    ),
    "index_keywords": Entity(
        "index_keywords", "list", "Keyword",
        ("Index Keywords", "Index keywords", "index_keywords", "ID", "Indexed Keywords", "Keywords Plus"),
    ),
    "affiliations": Entity(
        "affiliations", "list", "Affiliation", ("Affiliations", "Affiliation", "affiliations", "C1", "C3")
    ),
    "countries": Entity(
        "countries", "list", "Country",
        ("Countries of Authors", "Countries", "Country", "countries", "CA Country", "authorships.countries"),
    ),
    "document_types": Entity(
        "doc_type", "single", "Document Type", ("Document Type", "Document type", "type", "DT", "Type", "doc_type")
    ),
    "years": Entity("year", "single", "Year", ("Year", "Publication Year", "publication_year", "PY", "year")),
    "references": Entity(
        "references", "list", "Reference",
        ("References", "Cited References", "references", "CR", "referenced_works"),
    ),
    "subject_areas": Entity(
        "subject_areas", "list", "Subject Area",
        ("Subject Area", "Subject Areas", "Research Areas", "WC", "SC", "Topics", "subject_areas"),
    ),
    "sponsors": Entity("sponsors", "list", "Sponsor", ("Funding Sponsor", "Funding", "Funders", "FU", "sponsors")),
    "title": Entity("title", "text", "Term", ("Title", "title", "TI", "Article Title")),
    "abstract": Entity("abstract", "text", "Term", ("Abstract", "abstract", "AB", "Description")),
}

# Names of the scalar fields.
SCALARS: dict[str, tuple[str, ...]] = {
    "doc_id": ("doc_id", "EID", "UT", "unique-id", "openalex_id", "id"),
    "cited_by": ("Cited by", "Times Cited", "Citation Count", "cited_by_count", "TC", "cited_by"),
    "is_oa": ("is_oa", "Open Access", "open_access", "OA", "OA Status"),
    "language": ("Language of Original Document", "Language", "LA", "language"),
    "doi": ("DOI", "doi", "DI"),
}

LIST_FIELDS = tuple(e.column for e in ENTITIES.values() if e.kind == "list")


def resolve_column(df: DataFrame, aliases: tuple[str, ...] | list[str], partial: bool = False) -> str | None:
    """First alias that is present: exact, then ignoring case, then (optionally) inside a name."""
    for name in aliases:
        if name in df.columns:
            return name
    folded = {c.lower(): c for c in reversed(df.columns)}
    for name in aliases:
        if name.lower() in folded:
            return folded[name.lower()]
    if partial:
        for name in aliases:
            for c in df.columns:
                if name.lower() in c.lower():
                    return c
    return None


def detect_dialect(df: DataFrame) -> str:
    """``openalex``, ``scopus``, ``wos`` or ``unknown`` from the column names, then the ids."""
    cols = set(df.columns)
    if cols & {"referenced_works", "ids.openalex", "openalex_id"}:
        return "openalex"
    for c in ("unique-id", "id", "DOI"):
        if c in cols:
            if not df.filter(F.col(f"`{c}`").cast("string").contains("openalex.org")).isEmpty():
                return "openalex"
    if cols & {"EID", "Source title"}:
        return "scopus"
    if cols & {"UT", "WOS"}:
        return "wos"
    return "unknown"


def separator_scores(df: DataFrame, cols: list[str], share: float = 0.15) -> DataFrame:
    """One row: for each separator the number of columns where over ``share`` of the values contains it (one scan)."""
    def over(c: str, s: str) -> Column:
        return F.coalesce((F.avg(F.col(f"`{c}`").cast("string").contains(s).cast("int")) > share).cast("long"), F.lit(0))

    votes = df.agg(*[sum((over(c, s) for c in cols), F.lit(0)).cast("long").alias(n) for n, s in (("pipe", "|"), ("semicolon_space", "; "), ("semicolon", ";"))])
    chosen = (
        F.when((F.col("pipe") >= F.col("semicolon_space")) & (F.col("pipe") > 0), "|")
        .when(F.col("semicolon_space") > 0, "; ")
        .when(F.col("semicolon") > 0, ";")
        .otherwise("; ")
    )
    return votes.withColumn("separator", chosen)


def detect_separator(df: DataFrame, cols: list[str]) -> str:
    """The dominant separator of the multi-valued columns (one small aggregate)."""
    present = [c for c in cols if c in df.columns]
    return separator_scores(df, present).first()["separator"] if present else "; "


def first_separator(df: DataFrame, col: str) -> str | None:
    """First of ``|``, ``; ``, ``,`` that occurs anywhere in the column."""
    text = df.select(F.col(f"`{col}`").cast("string").alias("v"))
    row = text.agg(*[F.max(F.col("v").contains(s)).alias(n) for n, s in (("a", "|"), ("b", "; "), ("c", ","))])
    hit = row.first()
    return "|" if hit.a else "; " if hit.b else "," if hit.c else None


# What a flag column may say for yes.
YES = ("yes", "true", "1", "1.0", "t", "y")


def flag(col) -> F.Column:
    """Boolean from a boolean, number or yes/no text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*YES), F.lit(False))


def harmonize(df: DataFrame, sep: str | None = None) -> DataFrame:
    """Canonical works table; missing fields become nulls or empty lists, rows keep their number."""
    out = {}
    ident = resolve_column(df, SCALARS["doc_id"])
    out["doc_id"] = F.col(f"`{ident}`") if ident else F.sha2(
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])), 256
    )
    for e in ENTITIES.values():
        name = resolve_column(df, e.aliases)
        if e.kind == "list":
            if name is None:
                out[e.column] = F.array().cast("array<string>")
            else:
                out[e.column] = F.coalesce(as_items(df, name, sep), F.array().cast("array<string>"))
        elif e.column == "year":
            out["year"] = to_number(F.col(f"`{name}`").cast("string"), kind="double").cast("int") if name else F.lit(None).cast("int")
        else:
            out[e.column] = F.col(f"`{name}`").cast("string") if name else F.lit(None).cast("string")
    for field in ("cited_by", "is_oa", "language", "doi"):
        name = resolve_column(df, SCALARS[field])
        if field == "cited_by":
            out[field] = to_number(F.col(f"`{name}`").cast("string"), 0).cast("long") if name else F.lit(0).cast("long")
        elif field == "is_oa":
            out[field] = flag(F.col(f"`{name}`")) if name else F.lit(None).cast("boolean")
        else:
            out[field] = F.col(f"`{name}`").cast("string") if name else F.lit(None).cast("string")
    return df.select(*[v.alias(k) for k, v in out.items()])
