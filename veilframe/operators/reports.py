"""Reports in Markdown: what was done to a release, what it risks, what it is good for.

Figures come as small frames, such as those of `risk`, `utility` and `release`. A frame
above ROWS rows is refused, not cut: a report is no place for a table of records. Write
a report by `guard.write_text`, which scans it first."""

from __future__ import annotations

from dataclasses import fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.numeric import percent
from veilframe.operators.transforms import ReleaseConfig
from veilframe.operators.verdict import compliance

#: Most rows of a table in a report.
ROWS = 200
#: What stands for a figure that was not measured.
UNMEASURED = "not measured"

RISKS = {
    "r1": "R1: rows that are alone with their quasi-identifiers",
    "r2": "R2: subscribers told apart by a few known points",
    "r3": "R3: subscribers that stand out",
    "a1": "A1: uniqueness in the release",
    "a2": "A2: re-identification by known points",
    "a3": "A3: groups that share a sensitive value",
    "a4": "A4: volumes at the caps",
    "a5": "A5: differences of neighbouring cells",
    "a6": "A6: membership",
    "verdicts": "Verdicts",
}
USES = {
    "u1": "U1: accuracy of cells",
    "u2": "U2: coverage",
    "u3": "U3: ranks of areas",
    "u4": "U4: error of counts by epsilon",
    "u5": "U5: fidelity of records",
}


def shown(value) -> str:
    """A figure as text that keeps a Markdown table whole."""
    if value is None:
        return UNMEASURED
    text = f"{value:.4g}" if isinstance(value, float) else str(value)
    return text.replace("\\", "\\\\").replace("|", "\\|").replace("\r", " ").replace("\n", " ")


def grid(header: list[str], rows: list) -> str:
    lines = [header, ["---"] * len(header), *[[shown(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def frame(df: DataFrame) -> str:
    """A small frame as a table, its rows in the order of their values."""
    rows = df.limit(ROWS + 1).collect()
    if len(rows) > ROWS:
        raise ValueError(f"a table of more than {ROWS} rows")
    return grid(df.columns, sorted(rows, key=lambda r: [(v is None, isinstance(v, str), v if isinstance(v, (int, float, str)) else str(v)) for v in r]))


def document(title: str, sections: list[tuple[str, str]]) -> str:
    return "\n\n".join([f"# {title}", *[f"## {head}\n\n{body}" for head, body in sections]]) + "\n"


def figures(title: str, headings: dict[str, str], frames: dict[str, DataFrame]) -> str:
    """One section for each heading; one without a frame says that it was not measured."""
    if wrong := sorted(set(frames) - set(headings)):
        raise ValueError(f"no section for {wrong}")
    return document(title, [(head, frame(frames[name]) if name in frames else UNMEASURED) for name, head in headings.items()])


def risk_report(frames: dict[str, DataFrame]) -> str:
    return figures("Risk of re-identification", RISKS, frames)


def utility_report(frames: dict[str, DataFrame]) -> str:
    return figures("Utility of the release", USES, frames)


def transformations_report(config: ReleaseConfig, effective_minutes: int | None, statistics: DataFrame | None = None, treatments: DataFrame | None = None) -> str:
    """The parameters of a release, but for its secret salt, the bucket that was used, what
    suppression did, and the treatment of each field."""
    settings = [(f.name, getattr(config, f.name)) for f in fields(config) if f.name != "salt"]
    parts = [("Parameters", grid(["parameter", "value"], [*settings, ("effective_bucket_minutes", effective_minutes)]))]
    parts.append(("Suppression", UNMEASURED if statistics is None else frame(statistics)))
    if treatments is not None:
        parts.append(("Fields", frame(treatments)))
    return document("Transformations", parts)


def compliance_report(config: ReleaseConfig, published: dict[str, object]) -> str:
    return document("Compliance", [("Requirements", grid(["requirement", "measure", "figure"], compliance(config, published)))])


#: What each attack measures (fixed values: the wording of the story).
ATTACKS = {
    "A1": ("Row uniqueness", "no_record_isolation"), "A2": ("Trajectory linkage", "no_linkage"), "A3": ("Attribute homogeneity", "no_inference"),
    "A4": ("Outliers", "no_record_isolation"), "A5": ("Aggregate differencing", "no_inference"), "A6": ("Membership inference", "no_inference"),
}


def shares(cells: DataFrame, column: str, count: str = "n_subscribers") -> DataFrame:
    """One row: the share of each value of `column` among the subscribers of cells, the
    largest first and equal ones by value. Empty without cells."""
    by = cells.groupBy(column).agg(F.sum(count).alias("n"))
    whole = by.agg(F.sum("n").alias("all"))
    each = by.crossJoin(F.broadcast(whole)).select(F.struct((-F.col("n")).alias("o"), F.col(column).cast("string").alias("value"), percent(F.col("n"), F.col("all")).alias("share")).alias("x"))
    return each.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.struct(x["value"].alias("value"), x["share"].alias("share"))).alias("shares"))


def listed(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """One row: the rows of a small frame as an array of structs, in the order of `order`."""
    rows = df.select(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*df.columns).alias("row")).alias("x"))
    return rows.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["row"]).alias(name))


def attack_summaries(figures: dict[str, Column]) -> Column:
    """An array of each attack's name, the criterion it speaks to, and its figure."""
    return F.array(*[F.struct(F.lit(a).alias("id"), F.lit(name).alias("name"), F.lit(criterion).alias("criterion"), figures[a].alias("figure")) for a, (name, criterion) in ATTACKS.items()])


def story(sections: dict[str, DataFrame]) -> DataFrame:
    """One row (payload): a JSON object with one member for each section. A section is a
    frame of at most one row: with one column its value, else an object; one without a
    row is null. Figures that were not measured are null, and all members are there."""
    rows = []
    for name, df in sections.items():
        value = F.col(df.columns[0]) if len(df.columns) == 1 else F.struct(*df.columns)
        rows.append(df.agg(F.first(value).alias(name)))
    one = reduce(lambda x, y: x.crossJoin(F.broadcast(y)), rows)
    return one.select(F.to_json(F.struct(*sections), {"ignoreNullFields": "false"}).alias("payload"))


def treatments(fields_of: DataFrame, applied: DataFrame, field: str = "field", treatment: str = "treatment") -> DataFrame:
    """`fields_of` with the treatments of `applied` (field, treatment) put in; fields that
    it does not name keep theirs. Other columns stay."""
    new = applied.groupBy(F.col(field).alias("_f")).agg(F.max(treatment).alias("_t"))
    out = fields_of.join(new, F.col(field) == F.col("_f"), "left")
    return out.withColumn(treatment, F.coalesce("_t", treatment)).drop("_f", "_t")
