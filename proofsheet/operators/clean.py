"""Audited cleaning of a working copy (§3.1 order is kept).

1 text normalise → 2 summary rows (and user deletions) out → 3 all-null
columns out → 4 row formulas, numeric and date coercion → 5 exact
duplicates out (keep first) → 6 missing snapshot → 7 manual overrides or
derived repairs → 8 identifier sequences → 9 mean / median / label / retain.

Per-row counters travel as columns and are summed by the aggregates the
pipeline needs anyway; the audit is a long ``actions`` table, never a
driver-side list of rows.  The working copy is checkpointed (reliable) after
de-duplication and again after repairs, so later metrics never recompute
the cleaning and survive executor loss.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofsheet.functions import names as N
from proofsheet.functions import vocab as V
from proofsheet.functions.expr import (
    any_of, col, is_numeric_type, normalize_text, parse_date, parse_numeric, text_changed, utrim,
)
from proofsheet.operators.metrics import exact_sum
from proofsheet.operators.fingerprints import groups
from proofsheet.operators.positions import dense_position, exact_quantiles, join_small
from proofsheet.operators.profile import ColumnProfile, date_formats
from proofsheet.session import cut_lineage

SRC = "__source_row"

ACTIONS_SCHEMA = T.StructType([
    T.StructField("column", T.StringType()),
    T.StructField("strategy", T.StringType()),
    T.StructField("source_row", T.LongType()),
    T.StructField("fill_value", T.StringType()),
    T.StructField("explanation", T.StringType()),
])

EXPLAIN = {
    "derived_total": "total rebuilt as quantity times unit price instead of an estimate",
    "derived_price": "unit price rebuilt as total divided by quantity",
    "derived_quantity": "quantity rebuilt as total divided by unit price after proving it is a whole number",
    "sequential": "identifier completed from the proven ascending sequence of neighbouring rows",
    "mean": "filled with the mean of the valid values of the monetary column",
    "median": "filled with the median of the valid values to limit the effect of outliers",
    "label": "labelled Unspecified instead of inventing a category",
    "retained": "kept for review because filling it automatically could fabricate a value",
    "manual": "replaced with the value the user entered",
    "manual_retained": "the user entered no value for this cell; kept missing for review",
}


@dataclass
class CleanResult:
    cleaned: DataFrame
    counters: DataFrame
    actions: DataFrame
    removed_rows: DataFrame
    missing_before: DataFrame
    missing_locations: DataFrame
    profiles: list[ColumnProfile]
    excluded_empty_columns: list[str] = field(default_factory=list)

    def summary(self) -> DataFrame:
        """One sentence-ready row of the audit counters."""
        return audit_summary(self.counters)


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("__")]


# ------------------------------------------------------------------ step 1
def normalize_text_cells(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Normalised string cells + ``__txt`` = changed cells in the row."""
    columns = columns or data_columns(df)
    strs = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    changed = [text_changed(col(c)) for c in columns if c in strs]
    txt = sum(changed[1:], changed[0]) if changed else F.lit(0)
    keep = [c for c in df.columns if c not in columns]
    return df.select(*[col(c) for c in keep],
                     *[(normalize_text(col(c)) if c in strs else col(c)).alias(c) for c in columns],
                     txt.alias("__txt"))


# ------------------------------------------------------------------ step 2
def summary_row_predicate(df: DataFrame, profiles: list[ColumnProfile]) -> Column:
    """First present cell in column 0/1 reads like a total label, and a
    descriptor cell is missing or a measure is present."""
    cols = data_columns(df)
    if not cols:
        return F.lit(False)
    roles = {p.name: p.semantic_role for p in profiles}
    descriptors = [c for c in cols if roles.get(c) not in {"measure", "date"}]
    measures = [c for c in cols if roles.get(c) == "measure"]
    first = cols[0]
    second = cols[1] if len(cols) > 1 else None

    def label_of(name):
        text = col(name).cast("string")
        return F.regexp_replace(utrim(text), r"(?U)\s+", " ")

    pattern = "(?iU)" + V.SUMMARY_LABEL_PATTERN
    from_first = col(first).isNotNull() & label_of(first).rlike(pattern)
    desc_missing_0 = any_of([col(c).isNull() for c in descriptors if c != first])
    has_measure = any_of([col(c).isNotNull() for c in measures])
    pred = from_first & (desc_missing_0 | has_measure)
    if second is not None:
        from_second = col(first).isNull() & col(second).isNotNull() & label_of(second).rlike(pattern)
        desc_missing_1 = any_of([col(c).isNull() for c in descriptors if c != second])
        pred = pred | (from_second & (desc_missing_1 | has_measure))
    return F.coalesce(pred, F.lit(False))


# ------------------------------------------------------------------ step 4
def _letters_index(letters: Column) -> Column:
    """Excel column letters (1–3) → 0-based index."""
    u = F.upper(letters)
    a = [F.ascii(F.substring(u, i, 1)) - 64 for i in (1, 2, 3)]
    n = F.length(u)
    return (F.when(n == 1, a[0]).when(n == 2, a[0] * 26 + a[1]).otherwise(a[0] * 676 + a[1] * 26 + a[2])) - 1


def evaluate_row_formula(cell: Column, operands: list[Column], own_row: Column) -> Column:
    """``=<col><row> op <col><row>`` on the cell's own row only; operand
    columns resolved by their original ordinal; ``/0`` and anything else → null."""
    g = [F.regexp_extract(cell, V.ROW_FORMULA_PATTERN, i) for i in range(1, 6)]
    matched = cell.rlike(V.ROW_FORMULA_PATTERN)
    arr = F.array(*operands) if operands else F.array(F.lit(None).cast("double"))
    li, ri = _letters_index(g[0]), _letters_index(g[3])
    left = F.when(li < len(operands), F.element_at(arr, li + 1))
    right = F.when(ri < len(operands), F.element_at(arr, ri + 1))
    same_row = (g[1].cast("long") == own_row) & (g[4].cast("long") == own_row)
    op = g[2]
    value = (F.when(op == "+", left + right).when(op == "-", left - right)
             .when(op == "*", left * right).when(op == "/", F.when(right != 0, left / right)))
    return F.when(matched & same_row, value)


def coerce_columns(df: DataFrame, profiles: list[ColumnProfile], original_order: list[str],
                   src: str = SRC, formats: dict[str, str] | None = None) -> DataFrame:
    """Typed measures and dates + per-row counters
    ``__nconv __ninv __dconv __dinv __formula``.  Text dates are read by the
    format of their column in ``formats``, cells of another form are invalid.

    Text columns are parsed once into staging columns; row formulas of a
    measure read those (or the already-typed earlier measures), and every
    counter is computed before its column is replaced."""
    present = set(df.columns)
    fields = {f.name: f.dataType for f in df.schema.fields}
    string_measures = [p.name for p in profiles if p.semantic_role == "measure" and p.name in present
                       and isinstance(fields[p.name], T.StringType)]
    out = df
    staged: dict[str, str] = {}
    if string_measures:
        texts = [o for o in original_order if o in present and isinstance(fields[o], T.StringType)]
        staged = {o: f"__pnum{i}" for i, o in enumerate(texts)}
        out = out.select("*", *[parse_numeric(col(o), T.StringType()).alias(staged[o]) for o in texts])
    counters = {k: [] for k in ("__nconv", "__ninv", "__dconv", "__dinv", "__formula")}
    typed_measures: set[str] = set()
    typed_dates: set[str] = set()
    for k, p in enumerate(profiles):
        name = p.name
        if name not in present:
            continue
        dt = fields[name]
        c = col(name)
        if p.semantic_role == "measure":
            if isinstance(dt, T.StringType):
                operands = []
                for o in original_order:
                    if o not in present or o in typed_dates:
                        operands.append(F.lit(None).cast("double"))
                    elif o in typed_measures:
                        operands.append(col(o))
                    elif o in staged:
                        operands.append(F.col(staged[o]))
                    else:
                        operands.append(parse_numeric(col(o), fields[o]))
                out = out.withColumn("__fx", evaluate_row_formula(c, operands, col(src)))
                out = out.withColumn("__px", F.coalesce(F.col("__fx"), F.col(staged[name])))
                out = (out.withColumn(f"__formula{k}", F.when(F.col("__fx").isNotNull(), 1).otherwise(0))
                          .withColumn(f"__nconv{k}", F.when(c.isNotNull() & F.col("__fx").isNull() & F.col("__px").isNotNull(), 1).otherwise(0))
                          .withColumn(f"__ninv{k}", F.when(c.isNotNull() & F.col("__px").isNull(), 1).otherwise(0)))
                counters["__formula"].append(f"__formula{k}")
                counters["__nconv"].append(f"__nconv{k}")
                out = out.withColumn(name, F.col("__px")).drop("__fx", "__px")
            else:
                out = out.withColumn(f"__ninv{k}", F.when(c.isNotNull() & parse_numeric(c, dt).isNull(), 1).otherwise(0))
                out = out.withColumn(name, parse_numeric(c, dt))
            counters["__ninv"].append(f"__ninv{k}")
            typed_measures.add(name)
        elif p.semantic_role == "date":
            out = out.withColumn("__dx", parse_date(c, dt, (formats or {}).get(name)))
            if not isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                out = out.withColumn(f"__dconv{k}", F.when(c.isNotNull() & F.col("__dx").isNotNull(), 1).otherwise(0))
                counters["__dconv"].append(f"__dconv{k}")
            out = out.withColumn(f"__dinv{k}", F.when(c.isNotNull() & F.col("__dx").isNull(), 1).otherwise(0))
            counters["__dinv"].append(f"__dinv{k}")
            out = out.withColumn(name, F.col("__dx")).drop("__dx")
            typed_dates.add(name)
    for key, parts in counters.items():
        total = sum((F.col(x) for x in parts[1:]), F.col(parts[0])) if parts else F.lit(0)
        out = out.withColumn(key, total.cast("int"))
    drop = [x for parts in counters.values() for x in parts] + list(staged.values())
    return out.drop(*drop)


# ------------------------------------------------------------------ step 5
def drop_duplicates_keep_first(df: DataFrame, src: str = SRC, carry: list[str] | None = None,
                               extra_keys: list[str] | None = None) -> DataFrame:
    """Exact duplicates over every data column (null equals null) go;
    the survivor is the smallest source row (``src``: unique).  ``carry`` counter
    columns are summed over each group; ``__dups`` = removed rows of the group,
    ``__n`` its rows.

    Only fingerprints and source rows are shuffled (``fingerprints.groups``);
    the rows removed and the sums of repeated groups meet the table by its
    source row, broadcast where they are few."""
    cols = data_columns(df) + list(extra_keys or [])
    carry = carry or []
    first, removed = groups(df, cols, src, carry)
    kept = df.select(*[col(c) for c in cols], col(src), *[F.col(c).cast("long").alias(c) for c in carry])
    kept = join_small(kept, removed, src, "left_anti")
    kept = join_small(kept, first.select(src, F.col("n").alias("__g"), *[F.col(c).alias(f"__s_{c}") for c in carry]), src, "left")
    n = F.coalesce("__g", F.lit(1)).cast("long")
    return kept.select(*[col(c) for c in cols], col(src), (n - 1).alias("__dups"), n.alias("__n"),
                       *[F.coalesce(f"__s_{c}", F.col(c)).alias(c) for c in carry])


def duplicate_rows(df: DataFrame, kept: DataFrame, src: str = SRC) -> DataFrame:
    """Source rows removed as duplicates (anti-join on the unique row key)."""
    return df.select(src).join(kept.select(src), src, "left_anti")


# ------------------------------------------------------------------ step 6
def missing_locations(df: DataFrame, columns: list[str] | None = None, src: str = SRC) -> DataFrame:
    """Long ``(column, source_row)`` of every missing cell."""
    columns = columns or data_columns(df)
    cells = F.array(*[F.when(col(c).isNull(), F.lit(c)) for c in columns])
    return (df.select(col(src).alias("source_row"), F.explode(cells).alias("column"))
              .where(F.col("column").isNotNull()).select("column", "source_row"))


def missing_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One aggregate → long ``(ordinal, column, missing)``."""
    columns = columns or data_columns(df)
    one = df.agg(*[F.count_if(col(c).isNull()).alias(f"m{i}") for i, c in enumerate(columns)])
    structs = [F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.col(f"m{i}").cast("long").alias("missing"))
               for i, c in enumerate(columns)]
    return one.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


# ------------------------------------------------------------------ step 7
def derived_repairs(df: DataFrame, profiles: list[ColumnProfile]) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """total = qty × price, price = total ÷ qty, qty = total ÷ price
    (only when whole).  Adds flag columns; returns (flag, column, fill text)."""
    qty = N.find_profile_column(profiles, "measure", V.QUANTITY_TERMS)
    price = N.find_profile_column(profiles, "measure", V.UNIT_PRICE_TERMS)
    total = N.find_profile_column(profiles, "measure", V.TOTAL_TERMS)
    if not qty or not price or not total or any(n not in df.columns for n in (qty, price, total)):
        return df, []
    q, p, t = col(qty), col(price), col(total)
    out = df.withColumn("__rep_total", t.isNull() & q.isNotNull() & p.isNotNull())
    out = out.withColumn(total, F.when(F.col("__rep_total"), q * p).otherwise(t))
    out = out.withColumn("__rep_price", p.isNull() & t.isNotNull() & q.isNotNull() & (q != 0))
    out = out.withColumn(price, F.when(F.col("__rep_price"), t / q).otherwise(p))
    cand = F.when(p != 0, t / p)
    whole = F.abs(cand - F.rint(cand)) <= F.greatest(F.lit(1e-9), F.lit(1e-9) * F.abs(cand))
    out = out.withColumn("__rep_qty", q.isNull() & t.isNotNull() & p.isNotNull() & F.coalesce(whole, F.lit(False)))
    out = out.withColumn(qty, F.when(F.col("__rep_qty"), F.rint(cand)).otherwise(q))
    flags = [("__rep_total", total, f"{qty} × {price}", "derived_total"),
             ("__rep_price", price, f"{total} ÷ {qty}", "derived_price"),
             ("__rep_qty", qty, f"{total} ÷ {price}", "derived_quantity")]
    return out, flags


def _mode(df: DataFrame, key: str) -> tuple[object, int] | None:
    """Most frequent key (smallest on ties) and its count — a top-1."""
    r = df.groupBy(key).count().orderBy(F.col("count").desc(), F.col(key).asc()).limit(1).collect()
    return (r[0][0], int(r[0][1])) if r else None


def sequential_identifier(df: DataFrame, name: str, src: str = SRC) -> tuple[DataFrame, str | None]:
    """Fill missing ids from a proven +1 sequence over the dense
    position (0-based, by source row).  Returns (frame with ``__rep_seq_<name>``,
    description) or (frame unchanged, None)."""
    dt = df.schema[name].dataType
    pos = dense_position(df, src, "__pos")
    c = col(name)
    num = parse_numeric(c, dt)
    integral = num.isNotNull() & (F.abs(num - F.rint(num)) <= 1e-9)
    # whole numbers keep all their digits; only other notations go through double
    whole = c.try_cast("decimal(38,0)") if isinstance(dt, T.IntegralType) else F.when(
        utrim(c.cast("string")).rlike(r"^[+-]?\d{1,37}$"), utrim(c.cast("string")).try_cast("decimal(38,0)"))
    number = F.coalesce(whole, F.when(integral, F.rint(num).try_cast("decimal(38,0)")))
    known = pos.where(c.isNotNull()).select("__pos", c.alias("__v"), number.alias("__n"))
    known = cut_lineage(known)
    numeric = known.where(F.col("__n").isNotNull()).select((F.col("__n") - F.col("__pos")).alias("__off"))
    n_numeric = numeric.count()
    flag = f"__rep_seq_{name}"
    if n_numeric >= 3:
        base, hits = _mode(numeric, "__off")
        if hits / n_numeric >= V.SEQUENCE_SHARE_THRESHOLD:
            fill = (F.lit(base) + F.col("__pos"))
            fill = fill.cast("string") if isinstance(dt, T.StringType) else fill.cast(dt)
            out = pos.withColumn(flag, c.isNull()).withColumn(name, F.when(c.isNull(), fill).otherwise(c)).drop("__pos")
            return out, "numeric sequence +1"
    text = (known.where(F.col("__n").isNull())
            .select("__pos", F.regexp_extract(utrim(F.col("__v").cast("string")), r"^(.*?)(\d+)$", 1).alias("__prefix"),
                    F.regexp_extract(utrim(F.col("__v").cast("string")), r"^(.*?)(\d+)$", 2).alias("__digits"))
            .where(F.col("__digits") != ""))
    n_text = text.count()
    if n_text >= 3:
        prefix, n_match = _mode(text, "__prefix")
        matching = text.where(F.col("__prefix") == prefix).select(
            (F.col("__digits").try_cast("decimal(38,0)") - F.col("__pos")).alias("__off"), F.length("__digits").alias("__w"))
        base, hits = _mode(matching, "__off")
        width, _ = _mode(matching, "__w")
        if n_match / n_text >= V.SEQUENCE_SHARE_THRESHOLD and hits / n_match >= V.SEQUENCE_SHARE_THRESHOLD:
            number = (F.lit(base) + F.col("__pos")).cast("string")
            padded = F.when(F.length(number) >= width, number).otherwise(F.lpad(number, width, "0"))
            fill = F.concat(F.lit(prefix), padded)
            out = pos.withColumn(flag, c.isNull()).withColumn(name, F.when(c.isNull(), fill.cast(dt)).otherwise(c)).drop("__pos")
            return out, f"sequence {prefix}… +1"
    return df, None


# ------------------------------------------------------------------ step 9
def fill_value_for(df: DataFrame, p: ColumnProfile, label: str, quantiles: str = "exact"):
    """Strategy and fill value of one column (scalar aggregates only)."""
    c = col(p.name)
    if p.semantic_role == "measure":
        if N.is_monetary(p.name):
            r = df.agg(exact_sum(c).alias("s"), F.count(c).alias("n")).collect()[0]
            if not r["n"]:
                return "retained", None
            return "mean", r["s"] / r["n"]
        if quantiles == "approx":
            r = df.agg(F.percentile_approx(c, 0.5, 10000).alias("m")).collect()[0]["m"]
        else:
            rows = exact_quantiles(df, p.name, [0.5]).collect()
            r = rows[0]["q"] if rows else None
        return ("median", float(r)) if r is not None else ("retained", None)
    if p.semantic_role == "dimension":
        return "label", label
    return "retained", None


def delete_rows(df: DataFrame, rows: DataFrame | list[int] | None, src: str = SRC) -> DataFrame:
    """User-chosen row deletion by source row (anti-join)."""
    if rows is None:
        return df
    if isinstance(rows, list):
        rows = df.sparkSession.createDataFrame([(int(r),) for r in rows], f"{src} long")
    return join_small(df, rows.select(col(src)).distinct(), src, "left_anti")


def apply_overrides(df: DataFrame, profiles: list[ColumnProfile], overrides: DataFrame, src: str = SRC) -> tuple[DataFrame, DataFrame]:
    """Manual values for missing cells, keyed by (column, source_row).

    Returns (frame, errors).  ``errors`` lists overrides that name an unknown
    column or row, a cell that is not missing, or a value that does not parse
    for the column's role; the caller raises when it is not empty."""
    roles = {p.name: p.semantic_role for p in profiles}
    cols = data_columns(df)
    ov = overrides.select(F.col("column").cast("string").alias("column"), F.col("source_row").cast("long").alias("source_row"),
                          F.col("value").cast("string").alias("value"))
    nulls = F.create_map(*[x for c in cols for x in (F.lit(c), col(c).isNull())])
    # keep only the rows an override names (broadcast semi-join: the big side
    # is filtered in place, never shuffled), then join small to small
    wanted = ov.select("source_row").distinct()
    cells = join_small(df.select(col(src).alias("source_row"), nulls.alias("__nulls")), wanted, "source_row", "left_semi")
    j = ov.join(cells, "source_row", "left")
    role = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(roles.get(c, "unknown")))])
    typed_num = parse_numeric(F.col("value"), T.StringType())
    typed_date = parse_date(F.col("value"), T.StringType())
    r = F.element_at(role, F.col("column"))
    problem = (F.when(~F.col("column").isin(cols), "unknown column")
               .when(F.col("__nulls").isNull(), "unknown row")
               .when(~F.element_at(F.col("__nulls"), F.col("column")), "cell is not missing")
               .when((r == "measure") & typed_num.isNull(), "not a valid number")
               .when((r == "date") & typed_date.isNull(), "not a valid date")
               .when(~r.isin("measure", "date") & (utrim(F.coalesce(F.col("value"), F.lit(""))) == ""), "blank value"))
    errors = j.select("column", "source_row", "value", problem.alias("error")).where(F.col("error").isNotNull())
    good = ov.where(F.col("column").isin(cols))
    out = df
    pivot_cols = cols
    piv = good.groupBy("source_row").pivot("column", pivot_cols).agg(F.first("value"))
    piv = piv.select(F.col("source_row").alias(src), *[col(c).alias(f"__ov_{i}") for i, c in enumerate(pivot_cols)])
    out = join_small(out, piv, src, "left")
    for i, c in enumerate(pivot_cols):
        raw = F.col(f"__ov_{i}")
        dt = df.schema[c].dataType
        if roles.get(c) == "measure":
            typed = parse_numeric(raw, T.StringType()).cast(dt) if is_numeric_type(dt) else parse_numeric(raw, T.StringType()).cast("string")
        elif roles.get(c) == "date":
            typed = parse_date(raw, T.StringType()).cast(dt) if not isinstance(dt, T.StringType) else utrim(raw)
        else:
            typed = utrim(raw).cast(dt)
        out = out.withColumn(f"__rep_manual_{c}", col(c).isNull() & raw.isNotNull())
        out = out.withColumn(c, F.coalesce(col(c), typed))
    out = out.drop(*[f"__ov_{i}" for i in range(len(pivot_cols))])
    return out, errors


# ------------------------------------------------------------------ driver
def clean_dataset(df: DataFrame, profiles: list[ColumnProfile], mode: str = "recommended",
                  overrides: DataFrame | None = None, deleted_rows=None, src: str = SRC,
                  label: str = V.UNSPECIFIED_LABEL, quantiles: str = "exact") -> CleanResult:
    """Create the typed working copy and its complete audit."""
    if mode not in {"recommended", "manual"}:
        raise ValueError("unsupported missing-value mode")
    spark = df.sparkSession
    original = data_columns(df)
    # 1 + 2: normalise, flag summary rows, apply user deletions
    s1 = normalize_text_cells(df, original)
    s1 = s1.withColumn("__summary", summary_row_predicate(s1.select(*original), profiles))
    if deleted_rows is not None:
        s1 = delete_rows(s1, deleted_rows, src)
    summary_rows = s1.where("__summary").select(col(src).alias("source_row"), F.lit("summary").alias("reason"))
    # 3 is decided from presence *before* coercion, outside summary rows
    pres = [f"__pres{i}" for i in range(len(original))]
    s1 = s1.select("*", *[(col(c).isNotNull() & ~F.col("__summary")).cast("int").alias(pres[i])
                          for i, c in enumerate(original)])
    # 4: formulas and coercion (summary rows are coerced too, never counted)
    carry = ["__nconv", "__ninv", "__dconv", "__dinv", "__formula"]
    text_dates = [p.name for p in profiles if p.semantic_role == "date" and p.name in original and isinstance(s1.schema[p.name].dataType, T.StringType)]
    formats = {}
    if text_dates:
        found = date_formats(s1.where(~F.col("__summary")), text_dates, src).where(F.col("format").isNotNull())
        formats = {r["column"]: r["format"] for r in found.select("column", "format").collect()}   # one row a column
    s3 = coerce_columns(s1, profiles, original, src, formats)
    s3 = s3.select(*[F.when(F.col("__summary"), F.lit(0)).otherwise(F.col(c)).alias(c) if c in carry else col(c)
                     for c in s3.columns])
    # 5: duplicates (keep first).  ONE pass over the source: summary rows ride
    # along as their own groups and every counter is summed in the same
    # aggregate; the result is the checkpointed working copy.
    dedup = cut_lineage(drop_duplicates_keep_first(s3, src, carry + ["__txt"] + pres, extra_keys=["__summary"]))
    stats = dedup.agg(
        F.sum("__n").alias("input_rows"),
        F.coalesce(F.sum("__txt"), F.lit(0)).alias("normalized_text_cells"),
        F.coalesce(F.sum(F.when(F.col("__summary"), F.col("__n"))), F.lit(0)).alias("excluded_summary_rows"),
        F.coalesce(F.sum(F.when(~F.col("__summary"), F.col("__dups"))), F.lit(0)).alias("__dups"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in carry + pres],
    ).collect()[0]
    empty = [c for i, c in enumerate(original) if stats[pres[i]] == 0]
    kept_cols = [c for c in original if c not in empty]
    kept_groups = dedup.where(~F.col("__summary"))
    dup_rows = duplicate_rows(s3.where(~F.col("__summary")), kept_groups, src) \
        .select(col(src).alias("source_row"), F.lit("duplicate").alias("reason"))
    work = kept_groups.select(col(src), *[col(c) for c in kept_cols])
    # 6: missing snapshot
    before = missing_counts(work, kept_cols)
    before_map = {r["column"]: r["missing"] for r in before.collect()}
    locations = missing_locations(work, kept_cols, src)
    # 7–9
    flags: list[tuple[str, str, str, str]] = []
    fills: list[tuple[str, str, object]] = []
    profiles_by = {p.name: p for p in profiles}
    if mode == "manual":
        if overrides is not None:
            work, errors = apply_overrides(work, profiles, overrides, src)
            bad = errors.limit(20).collect()
            if bad:
                raise ValueError("manual values rejected: " + "; ".join(
                    f"{b['column']} row {b['source_row']}: {b['error']}" for b in bad))
            flags += [(f"__rep_manual_{c}", c, None, "manual") for c in kept_cols]
    elif any(before_map.values()):
        work, derived = derived_repairs(work, profiles)
        flags += derived
        for p in profiles:
            if p.semantic_role != "identifier" or p.name not in kept_cols or not before_map.get(p.name):
                continue
            work, how = sequential_identifier(work, p.name, src)
            if how:
                flags.append((f"__rep_seq_{p.name}", p.name, how, "sequential"))
        if flags:  # repairs changed cells: fix them once before the fill statistics
            work = cut_lineage(work)
            now_missing = {r["column"]: r["missing"] for r in missing_counts(work, kept_cols).collect()}
        else:
            now_missing = dict(before_map)
        for p in profiles:
            if p.name not in kept_cols or not now_missing.get(p.name):
                continue
            strategy, value = fill_value_for(work, p, label, quantiles)
            fills.append((p.name, strategy, value))
        for name, strategy, value in fills:
            c = col(name)
            work = work.withColumn(f"__fill_{name}", c.isNull())
            if strategy != "retained":
                work = work.withColumn(name, F.coalesce(c, F.lit(value).cast(work.schema[name].dataType)))
    changed = bool(flags) or bool(fills)
    # Sequential ids (window + join) and manual overrides (join) are worth a
    # lineage cut; constant fills and derived arithmetic are projections over
    # the de-duplicated checkpoint and stay lazy.
    if any(strategy in ("sequential", "manual") for *_, strategy in flags):
        work = cut_lineage(work)
    # audit actions (long, lazy)
    parts = []
    for flag, column, fill, strategy in flags:
        if flag not in work.columns:
            continue
        parts.append(work.where(F.col(flag)).select(
            F.lit(column).alias("column"), F.lit("derived" if strategy.startswith("derived") else strategy).alias("strategy"),
            col(src).cast("long").alias("source_row"),
            (col(column).cast("string") if fill is None else F.lit(fill)).alias("fill_value"),
            F.lit(EXPLAIN[strategy]).alias("explanation")))
    for name, strategy, value in fills:
        parts.append(work.where(F.col(f"__fill_{name}")).select(
            F.lit(name).alias("column"), F.lit(strategy).alias("strategy"), col(src).cast("long").alias("source_row"),
            F.lit(None if value is None else str(value)).cast("string").alias("fill_value"),
            F.lit(EXPLAIN[strategy]).alias("explanation")))
    if mode == "manual":
        for c in kept_cols:
            parts.append(work.where(col(c).isNull()).select(
                F.lit(c).alias("column"), F.lit("retained").alias("strategy"), col(src).cast("long").alias("source_row"),
                F.lit(None).cast("string").alias("fill_value"), F.lit(EXPLAIN["manual_retained"]).alias("explanation")))
    actions = spark.createDataFrame([], ACTIONS_SCHEMA)
    for part in parts:
        actions = actions.unionByName(part)
    cleaned = work.select(col(src), *[col(c) for c in kept_cols])
    if flags:
        agg = cleaned.agg(F.count(F.lit(1)).alias("output_rows"),
                          *[F.count_if(col(c).isNull()).alias(f"r{i}") for i, c in enumerate(kept_cols)]).collect()[0]
        act = actions.groupBy("strategy").count().collect()
        imputed = sum(r["count"] for r in act if r["strategy"] != "retained")
    elif changed:  # only fills: counts follow from the snapshot taken before them
        filled = {name: strategy != "retained" for name, strategy, _ in fills}
        agg = {"output_rows": int(stats["input_rows"]) - int(stats["excluded_summary_rows"]) - int(stats["__dups"]),
               **{f"r{i}": (0 if filled.get(c) else int(now_missing.get(c, 0))) for i, c in enumerate(kept_cols)}}
        imputed = sum(int(now_missing.get(name, 0)) for name, strategy, _ in fills if strategy != "retained")
    else:  # nothing was repaired: the snapshot already holds the answer
        agg = {"output_rows": int(stats["input_rows"]) - int(stats["excluded_summary_rows"]) - int(stats["__dups"]),
               **{f"r{i}": int(before_map.get(c, 0)) for i, c in enumerate(kept_cols)}}
        imputed = 0
    counters = spark.createDataFrame([(
        int(stats["input_rows"]), int(agg["output_rows"]), int(stats["excluded_summary_rows"]), int(stats["__dups"]),
        int(stats["__nconv"]), int(stats["__dconv"]), int(stats["normalized_text_cells"] or 0), int(stats["__ninv"]),
        int(stats["__dinv"]), len(empty), int(stats["__formula"]), mode, int(sum(before_map.values())),
        int(sum(1 for v in before_map.values() if v)), int(imputed),
        int(sum(agg[f"r{i}"] for i in range(len(kept_cols)))),
    )], "input_rows long, output_rows long, excluded_summary_rows long, removed_duplicate_rows long, "
       "numeric_conversions long, date_conversions long, normalized_text_cells long, invalid_numeric_cells long, "
       "invalid_date_cells long, excluded_empty_columns long, formula_calculations long, missing_value_mode string, "
       "missing_values_before long, columns_with_missing long, imputed_values long, remaining_missing_values long")
    removed = summary_rows.unionByName(dup_rows)
    kept_profiles = [profiles_by[c] for c in kept_cols if c in profiles_by]
    return CleanResult(cleaned, counters, actions, removed, before.where(F.col("missing") > 0),
                       locations, kept_profiles, empty)


def audit_summary(counters: DataFrame) -> DataFrame:
    """English summary sentence built from the counters row."""
    parts = [
        ("numeric_conversions", "converted %d numeric/monetary values from text"),
        ("date_conversions", "converted %d values to dates"),
        ("excluded_summary_rows", "excluded %d structural total rows"),
        ("removed_duplicate_rows", "removed %d exact duplicate rows"),
        ("excluded_empty_columns", "excluded %d entirely empty columns"),
        ("formula_calculations", "evaluated %d safe row formulas"),
        ("missing_values_before", "found %d missing values"),
        ("imputed_values", "treated %d missing values under a documented policy"),
        ("normalized_text_cells", "normalised %d text cells"),
    ]
    items = [F.when(F.col(c) > 0, F.format_string(t, F.col(c))) for c, t in parts]
    body = F.concat_ws(", ", *items)
    text = F.when(body == "", F.lit("The working copy needed no safe conversions; the source file was not changed.")) \
        .otherwise(F.concat(F.lit("The working copy was cleaned: "), body, F.lit("; the source file was not changed.")))
    return counters.select("*", text.alias("summary"))
