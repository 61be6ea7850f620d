"""Deterministic sample data from specifications: every value is a function of a seed, the column and the row's number."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspec.functions.domains import DOMAINS, infer
from loomspec.functions.formats import to_java
from loomspec.schema import MOMENTS, NUMBERS, TEXT_TYPES, may_be_null, spark_type
from loomspec.spec import Column as ColumnSpec
from loomspec.spec import TableDefinition

#: Pools of names.
POOLS = {
    "person_first_name": ("Ada", "Ben", "Cleo", "Dan", "Eva", "Finn", "Gia", "Hugo", "Iris", "Jon"),
    "person_last_name": ("Abbott", "Barnes", "Cole", "Drake", "Ellis", "Ford", "Grant", "Hayes", "Irwin", "Jones"),
    "city": ("Ashford", "Brookside", "Clayton", "Dover", "Easton", "Fairview"),
    "us_state_code": ("AZ", "CA", "CO", "FL", "GA", "IL", "MA", "NY", "OH", "TX", "WA"),
    "gender": ("F", "M"),
    "yes_no_flag": ("Y", "N"),
    "claim_status": ("OPEN", "PAID", "DENIED"),
}
#: Forms of made values, by domain; domains with a list of values draw from it.
FORMS = {
    "zip_code": r"\d{5}", "npi": r"1\d{9}", "phone_number": r"555-\d{3}-\d{4}", "loinc_code": r"\d{4}-\d", "ndc_code": r"\d{5}-\d{4}-\d{2}", "drg_code": r"\d{3}", "revenue_code": r"0\d{3}",
    "bill_type_code": r"\d{3}", "place_of_service": r"\d{2}", "modifier_code": r"[A-Z][A-Z0-9]", "tax_id": r"\d{2}-\d{7}", "member_id": r"MBR\d{8}", "claim_number": r"CLM\d{9}", "calendar_year": r"20[0-2]\d",
    "amisys_member_id": r"[A-Z]{2}\d{11}", "vendor_identifier": r"[A-Z]{4}-[A-Z]{3}", "project_number": r"\d{5}", "project_code": r"[A-Z]{3}\d{4}", "reporting_population": r"H\d{4}", "population_type": r"[A-Z]{2}",
    "plan_description": r"[A-Z]{6}_MEDICARE", "address_line_1": r"\d{3} [A-Z][a-z]{5} St", "url": r"https://example\.com/\d{6}", "us_county": r"[A-Z][a-z]{6} County",
}
#: Parts that the keys of a pool are numbered in.
POOL_PARTS = 256


def draw(seed: int, *salt) -> Column:
    """A whole number from 0 to 2**31 - 1, of the row's number `id`, the seed and the salt."""
    return F.pmod(F.xxhash64("id", F.lit(seed), *(F.lit(s) for s in salt)), F.lit(1 << 31))


def unit(seed: int, *salt) -> Column:
    return draw(seed, *salt) / float(1 << 31)


def pick(values, seed: int, *salt) -> Column:
    array = F.array(*(F.lit(v) for v in values))
    return F.element_at(array, (F.pmod(draw(seed, *salt), F.lit(len(values))) + 1).cast("int"))


def skewed(n: int, seed: int, *salt) -> Column:
    """0 to n - 1; four of five draws fall in the first fifth."""
    hot = max(1, n // 5)
    return F.when(unit(seed, "hot", *salt) < 0.8, F.pmod(draw(seed, *salt), F.lit(hot))).otherwise(F.pmod(draw(seed, *salt), F.lit(n)))


def from_regex(regex: str, seed: int, *salt) -> Column:
    """A text that a simple pattern matches: classes, digits, literals, and {n}, {n,m}, ?, + and *."""
    token = re.compile(r"(\[[^\]]+\]|\\d|\\w|\\.|\(\?:|[()^$|]|.)(\{\d+(?:,\d*)?\}|[?+*])?")
    parts: list[Column] = []
    for i, (atom, times) in enumerate(token.findall(regex)):
        if atom in ("(", ")", "^", "$", "(?:"):
            continue
        if atom == "|":
            break
        n = int(re.match(r"\{(\d+)", times)[1]) if times.startswith("{") else 0 if times in ("?", "*") else 1
        for k in range(n):
            if atom == "\\d":
                parts.append(F.pmod(draw(seed, i, k, *salt), F.lit(10)).cast("string"))
            elif atom == "\\w":
                parts.append(pick("abcdefghij", seed, i, k, *salt))
            elif atom.startswith("["):
                inner = re.sub(r"(.)-(.)", lambda m: "".join(map(chr, range(ord(m[1]), ord(m[2]) + 1))), atom[1:-1].replace("\\d", "0-9"))
                parts.append(pick(inner, seed, i, k, *salt))
            else:
                parts.append(F.lit(atom.removeprefix("\\")))
    return F.concat(*parts) if parts else F.lit("")


def value(c: ColumnSpec, seed: int, rules: dict | None = None) -> Column:
    """One column's values: allowed values, then a pattern, then the domain, then the type."""
    kind, rules = c.type.upper(), rules or {}
    salt = c.name
    domain = c.domain_type or infer(None, c.name, c.description)[0]
    if rules.get("value_set"):
        out = pick(rules["value_set"], seed, salt)
    elif rules.get("regex"):
        out = from_regex(rules["regex"], seed, salt)
    elif kind == "BOOLEAN":
        out = draw(seed, salt) % 2 == 0
    elif kind == "EMBEDDING":
        n = c.dimension or 16
        raw = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt), i), F.lit(20001)) / 10000.0 - 1.0)
        norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
        out = F.transform(raw, lambda x: (x / norm).cast("float"))
    elif kind in MOMENTS:
        moment = F.timestamp_seconds(F.lit(1577836800) + F.pmod(draw(seed, salt), F.lit(126230400)))
        out = F.to_date(moment) if kind == "DATE" else moment
    elif kind in NUMBERS:
        least, most = DOMAINS.get(domain, {}).get("range", (0, 1000))
        low, high = rules.get("min_value", least), rules.get("max_value", 1000 if most is None else most)
        out = F.lit(low) + unit(seed, salt) * (high - low)
        out = F.floor(out) if kind not in ("DECIMAL", "FLOAT", "DOUBLE") else F.round(out, c.scale if c.scale is not None else 2)
    elif domain in POOLS:
        out = pick(POOLS[domain], seed, salt)
    elif domain == "email":
        out = F.concat(F.lower(pick(POOLS["person_first_name"], seed, salt)), F.lit("."), F.col("id").cast("string"), F.lit("@example.com"))
    elif domain in FORMS:
        out = from_regex(FORMS[domain], seed, salt)
    elif DOMAINS.get(domain, {}).get("values"):
        out = pick(DOMAINS[domain]["values"], seed, salt)
    else:
        out = F.concat(F.lit(c.name[:8] + "_"), F.lpad(F.col("id").cast("string"), 6, "0"))
    if kind in TEXT_TYPES:
        out = out.cast("string")
        out = F.substring(out, 1, c.length) if c.length else out
    if may_be_null(c):
        out = F.when(unit(seed, "null", salt) >= 0.05, out)
    return out


def generate(spark: SparkSession, specs: dict[str, TableDefinition], rows: int | dict[str, int], seed: int = 42, pools: dict[tuple[str, str], DataFrame] | None = None) -> dict[str, DataFrame]:
    """A frame for each specification, parents first. Keys number their rows; foreign keys name rows of their parents, most
    often a few of them. pools gives keys of tables that exist already, as (table, column) -> one-column frame."""
    out: dict[str, DataFrame] = {}
    count = lambda n: rows if isinstance(rows, int) else rows.get(n, 100)
    order = _by_foreign_keys(specs)
    for name in order:
        spec = specs[name]
        parents = {c: (t, p) for c, t, p in spec.foreign_keys}
        df = spark.range(count(name))
        columns = []
        for c in spec.ordered():
            rules = {k: v for r in spec.rules if r.column == c.name for k, v in r.kwargs.items() if k in ("value_set", "regex", "min_value", "max_value")}
            if c.name in parents and parents[c.name][0] in specs:
                n = skewed(count(parents[c.name][0]), seed, c.name)
                columns.append(key_value(specs[parents[c.name][0]].column(parents[c.name][1]), n).alias(c.name))
            elif c.name in parents and pools and parents[c.name] in pools:
                columns.append(skewed(1 << 20, seed, c.name).alias(f"__pool_{c.name}"))
            elif c.name in spec.primary_key:
                columns.append(key_value(c, F.col("id")).alias(c.name))
            else:
                made = value(c, seed, rules)
                columns.append((made if c.type.upper() == "EMBEDDING" else made.cast(spark_type(c))).alias(c.name))
        df = df.select(*columns)
        for c in [x for x in df.columns if x.startswith("__pool_")]:
            own = c.removeprefix("__pool_")
            df = _from_pool(df, c, own, pools[parents[own]])
        out[name] = df.select(*(c.name for c in spec.ordered()))
    return out


def _from_pool(df: DataFrame, number: str, name: str, pool: DataFrame) -> DataFrame:
    """df with a key of the pool as `name` for each number: keys have places by the order of their hashes within POOL_PARTS parts."""
    keys = pool.toDF(name).where(F.col(name).isNotNull()).distinct()
    placed = keys.withColumn("__part", F.pmod(F.xxhash64(name), F.lit(POOL_PARTS)))
    placed = placed.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(F.xxhash64(name, F.lit(1)), name)) - 1)
    sizes = [(r["__part"], r["n"]) for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect()]  # POOL_PARTS rows at most
    if not sizes:
        return df.withColumn(name, F.lit(None).cast(keys.schema[name].dataType)).drop(number)
    parts = F.array(*(F.struct(F.lit(p).cast("bigint").alias("part"), F.lit(n).cast("bigint").alias("n")) for p, n in sorted(sizes)))
    chosen = parts[F.pmod(F.col(number), F.lit(len(sizes))).cast("int")]
    df = df.withColumn("__chosen", chosen).withColumns({"__part": F.col("__chosen.part"), "__at": F.pmod(F.floor(F.col(number) / len(sizes)), F.col("__chosen.n")).cast("int")})
    return df.join(placed, ["__part", "__at"], "left").drop("__part", "__at", "__chosen", number)


def key_value(c: ColumnSpec, n: Column) -> Column:
    """The key of row n of its table."""
    if c.type.upper() in TEXT_TYPES:
        return F.concat(F.lit(c.name[:3].upper()), F.lpad(n.cast("string"), 8, "0"))
    if c.type.upper() in MOMENTS:
        return F.date_add(F.lit("2000-01-01").cast("date"), n.cast("int")).cast(spark_type(c))
    return n.cast(spark_type(c))


def _by_foreign_keys(specs: dict[str, TableDefinition]) -> list[str]:
    """Parents before children; what is in a cycle, or depends on one, comes last, by name."""
    from graphlib import CycleError, TopologicalSorter

    needs = {n: {t for _, t, _ in s.foreign_keys if t in specs and t != n} for n, s in specs.items()}
    try:
        return list(TopologicalSorter({n: sorted(needs[n]) for n in sorted(needs)}).static_order())
    except CycleError:
        done: list[str] = []
        while ready := sorted(n for n in needs if n not in done and needs[n] <= set(done)):
            done += ready
        return done + sorted(set(needs) - set(done))


def key_groups(specs: dict[str, TableDefinition]) -> list[set[tuple[str, str]]]:
    """Columns that share values because foreign keys link them, as sets of (table, column)."""
    up: dict[tuple[str, str], tuple[str, str]] = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for n, s in sorted(specs.items()):
        for c, t, p in s.foreign_keys:
            a, b = root((n, c)), root((t, p))
            up[max(a, b)] = min(a, b)
    groups: dict = {}
    for x in list(up):
        groups.setdefault(root(x), set()).add(x)
    return sorted(groups.values(), key=min)


def as_raw(df: DataFrame, spec: TableDefinition) -> DataFrame:
    """Typed rows as the text that a delimited source would hold."""
    out = []
    for c in spec.ordered():
        x = F.col(c.name)
        out.append((F.date_format(x, to_java(c.format)) if c.format and "Y" in c.format and c.type.upper() in MOMENTS else x.cast("string")).alias(c.name))
    return df.select(*out)


def file_name(pattern: str, values: dict[str, str]) -> str:
    """A name that the file name pattern matches, with given values for its named groups."""

    def fill(m: re.Match) -> str:
        return values.get(m[1], "x") if m[1] else ""

    out = re.sub(r"\(\?P<(\w+)>[^)]*\)", fill, pattern)
    return re.sub(r"[\^$]", "", out).replace("\\", "")


