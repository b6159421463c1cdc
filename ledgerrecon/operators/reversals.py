"""Reversal pairs: swapped account keys, values that cancel out.

Rows x and y reverse each other when ``x.a = y.b``, ``x.b = y.a`` and their values
add up to zero. Ordering the two account keys and flipping the sign with them
gives both rows the same group ``(low, high, level)`` and opposite sides, so a
self-join turns into one aggregation: a row has a partner exactly when the other
side of its group is not empty. A group whose keys are equal and whose level is
zero mirrors itself; there a row needs any second row.

Values are compared at nine decimal places. NULL keys match nothing; missing or
unparsable values count as 0. Pair lists are kept run-length encoded (one row per
group with its counts), since n rows against m rows are n * m pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerrecon.config import ReversalConfig
from ledgerrecon.functions import AMOUNT_SCALE, amount, column_type, key_part, number_or_zero, ref
from ledgerrecon.functions.refs import require
from ledgerrecon.labels import REVERSAL_FLAG, REVERSAL_GROUP, REVERSAL_STATUS
from ledgerrecon.operators.groups import HOT, HOT_ROWS, SLAB_ROWS, SPREAD, attach_group, complete_key, spread_of
from ledgerrecon.operators.ranks import sums_within
from ledgerrecon.session import shared_path

KEYS = ("__low__", "__high__", "__units__", "__nanos__")
NANOS = 1_000_000_000
UNIT = 10.0 ** -AMOUNT_SCALE
LEVEL = "decimal(28,9)"


def _account_keys(df: DataFrame, a: str, b: str) -> tuple[Column, Column]:
    """Both account columns in a comparable form: raw if of one type, else as key text."""
    a_type, b_type = column_type(df, a), column_type(df, b)
    if a_type == b_type and not isinstance(a_type, (T.FloatType, T.DoubleType)):
        return ref(a), ref(b)
    text = lambda name, dtype: F.when(ref(name).isNotNull(), key_part(ref(name), dtype))
    return text(a, a_type), text(b, b_type)


def _value(df: DataFrame, value: str) -> Column:
    """Value as a double, or a decimal as it is; missing is 0. Too large a value raises."""
    dtype = column_type(df, value)
    if isinstance(dtype, T.DecimalType):
        return F.coalesce(ref(value), F.lit(0).cast(dtype))
    number = number_or_zero(ref(value), dtype)
    return F.when(F.abs(number) < F.lit(9e18), number).otherwise(F.raise_error(F.lit("reversal values must be below 9e18")))


def _whole_and_nano(level: Column) -> tuple[Column, Column]:
    """Level at nine places as two integers, units and billionths (levels below 9e18).

    Integers hash and sort fast, and the same way in joins and aggregations; doubles
    would be normalised in one and not in the other, and so be shuffled twice.
    """
    nanos = F.floor((level - F.floor(level)) * F.lit(1e9) + F.lit(0.5)).cast("bigint")
    units = F.floor(level).cast("bigint") + F.when(nanos >= NANOS, 1).otherwise(0)
    # never NULL, so that null tests on the group keys fold away
    return F.coalesce(units, F.lit(0).cast("bigint")), F.coalesce(nanos % NANOS, F.lit(0).cast("bigint"))


def _sided(df: DataFrame, config: ReversalConfig) -> DataFrame:
    """Rows with their group (``KEYS``), their ``__level__`` and ``__side__`` (0 or 1)."""
    require(df, config.column_a, config.column_b, config.value_column)
    if config.tolerance is None or config.tolerance < 0:
        raise ValueError("tolerance must be a non-negative number")
    a, b = _account_keys(df, config.column_a, config.column_b)
    keyed = df.withColumns({"__a__": a, "__b__": b, "__v__": _value(df, config.value_column)})
    flipped = (F.col("__a__") > F.col("__b__")) | ((F.col("__a__") == F.col("__b__")) & (F.col("__v__") < 0))
    complete = F.col("__a__").isNotNull() & F.col("__b__").isNotNull()
    sided = keyed.withColumns({
        "__low__": F.when(complete, F.least("__a__", "__b__")),
        "__high__": F.when(complete, F.greatest("__a__", "__b__")),
        "__level__": F.when(flipped, -F.col("__v__")).otherwise(F.col("__v__")),
        "__side__": flipped.cast("int"),
    }).drop("__a__", "__b__", "__v__")
    units, nanos = _whole_and_nano(F.col("__level__"))
    return sided.withColumns({"__units__": units, "__nanos__": nanos})


def _groups(sided: DataFrame) -> DataFrame:
    """One row per mirrored group: rows on each side, rows in all."""
    return (
        sided.where(complete_key(KEYS))
        .groupBy(spread_of(KEYS).alias(SPREAD), *KEYS)
        .agg(F.count_if(F.col("__side__") == 0).alias("__n0__"), F.count_if(F.col("__side__") == 1).alias("__n1__"),
             F.min("__level__").cast("double").alias("__level__"))
        .withColumn("__n__", F.col("__n0__") + F.col("__n1__"))
    )


def _mirrors_itself() -> Column:
    return (F.col("__low__") == F.col("__high__")) & (F.col("__units__") == 0) & (F.col("__nanos__") == 0)


def _partners() -> Column:
    """How many partners a row has, from the counts of its group."""
    return (
        F.when(_mirrors_itself(), F.col("__n0__") - 1)
        .when(F.col("__side__") == 0, F.col("__n1__"))
        .otherwise(F.col("__n0__"))
    )


def reversal_pairs(df: DataFrame, config: ReversalConfig) -> DataFrame:
    """All pairs, run-length encoded: one row per mirrored group that has pairs.

    ``rows_forward`` rows read (low, high, level), ``rows_mirrored`` rows read
    (high, low, -level); every forward row pairs with every mirrored one. A group
    that mirrors itself has its rows in ``rows_forward`` and pairs any two of them.
    """
    own = F.col("__n0__").cast("decimal(19,0)")
    pairs = F.when(_mirrors_itself(), own * (own - 1) / 2).otherwise(own * F.col("__n1__"))
    return (
        _groups(_sided(df, config).select(*KEYS, "__level__", "__side__"))
        .select(
            F.col("__low__").alias("low"), F.col("__high__").alias("high"), F.col("__level__").cast("double").alias("level"),
            F.col("__n0__").alias("rows_forward"), F.col("__n1__").alias("rows_mirrored"),
            pairs.cast("decimal(38,0)").alias("pairs"),
        )
        .where(F.col("pairs") > 0)
    )


def reversal_rows(df: DataFrame, config: ReversalConfig, ordinal: str = "row_index",
                  hot_rows: int = HOT_ROWS, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """Rows that have partners: their group, their side in it and how many partners.

    With ``reversal_pairs`` this says which rows pair, at a size that grows with the
    rows and not with the pairs. With a tolerance wider than one billionth the level of a
    row is its own, and its partners' levels are at most the tolerance away.
    """
    require(df, ordinal)
    if config.tolerance > UNIT:
        return _rows_within(df, config, ordinal, hot_rows, slab_rows)
    sided = _sided(df, config).select(ref(ordinal), *KEYS, "__level__", "__side__").where(F.col("__low__").isNotNull())
    facts = attach_group(sided, _groups(sided), KEYS, ("__n0__", "__n1__"), "__n__", ordinal, hot_rows, slab_rows)
    return facts.withColumn("partners", _partners()).where(F.col("partners") > 0).select(
        ref(ordinal), F.col("__low__").alias("low"), F.col("__high__").alias("high"), F.col("__level__").cast("double").alias("level"),
        F.col("__side__").alias("side"), "partners",
    )


def _rows_within(df: DataFrame, config: ReversalConfig, ordinal: str, hot_rows: int, slab_rows: int) -> DataFrame:
    keys = ("__low__", "__high__", "__x__")
    base, places = _partners_within(_sided(df, config).where(F.col("__low__").isNotNull()), config)
    groups = places.withColumns({SPREAD: spread_of(keys), "__n__": F.col("n0") + F.col("n1")})
    rows = base.select(ref(ordinal), *keys, "__side__")
    found = attach_group(rows, groups, keys, ("within_n0", "within_n1"), "__n__", ordinal, hot_rows, slab_rows)
    partners = F.when(F.col("__side__") == 0, F.col("within_n1")).otherwise(F.col("within_n0")) - _itself(config)
    return found.withColumn("partners", partners).where(F.col("partners") > 0).select(
        ref(ordinal), F.col("__low__").alias("low"), F.col("__high__").alias("high"), F.col("__x__").cast("double").alias("level"),
        F.col("__side__").alias("side"), "partners",
    )


def reversal_pairs_one_to_one(df: DataFrame, config: ReversalConfig, ordinal: str = "row_index",
                              hot_rows: int = HOT_ROWS, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """Pairs (row_i, row_j) where each row is used once, first come first served.

    The k-th forward row of a group pairs with its k-th mirrored row. Ranks are
    counted inside slabs of consecutive ordinals and shifted by the rows of the
    slabs before, so a hot group is ranked by many tasks.
    """
    require(df, ordinal)
    spark = df.sparkSession
    sided = _sided(df, config).select(ref(ordinal).alias("__row__"), *KEYS, "__level__", "__side__").where(F.col("__low__").isNotNull())
    # counted once and kept: groups that have pairs, and hot ones without, whose rows must not meet in one task either
    folder = shared_path(spark, "groups")
    two_sided = (F.col("__n0__") > 0) & (F.col("__n1__") > 0) & ~_mirrors_itself()
    _groups(sided).where(two_sided | (F.col("__n__") > hot_rows)).write.parquet(folder)
    groups = spark.read.parquet(folder)
    matched = attach_group(sided, groups, KEYS, ("__n0__", "__n1__"), "__n__", "__row__", hot_rows, slab_rows).where(two_sided)

    # one cell is a whole group, or one slab of a hot group; the rows are already partitioned by it
    cell = [SPREAD, *KEYS]
    ranked = matched.withColumn("k", F.row_number().over(Window.partitionBy(*cell, "__side__").orderBy("__row__")))
    if not groups.where(F.col("__n__") > hot_rows).isEmpty():
        earlier = Window.partitionBy(*KEYS).orderBy(SPREAD).rowsBetween(Window.unboundedPreceding, -1)
        slabs = (
            matched.where(HOT).groupBy(*cell)
            .agg(F.count_if(F.col("__side__") == 0).alias("c0"), F.count_if(F.col("__side__") == 1).alias("c1"))
            .select(*cell, F.sum("c0").over(earlier).alias("before0"), F.sum("c1").over(earlier).alias("before1"))
        )
        before = F.when(F.col("__side__") == 0, F.col("before0")).otherwise(F.col("before1"))
        ranked = ranked.join(slabs, cell, "left").withColumn("k", F.col("k") + F.coalesce(before, F.lit(0)))
    pair = ranked.groupBy(*KEYS, "k").agg(
        F.max(F.when(F.col("__side__") == 0, F.col("__row__"))).alias("f"),
        F.max(F.when(F.col("__side__") == 1, F.col("__row__"))).alias("m"),
    )
    return pair.where(F.col("f").isNotNull() & F.col("m").isNotNull()).select(
        F.least("f", "m").alias("row_i"), F.greatest("f", "m").alias("row_j")
    )


def _matched_all_pairs(sided: DataFrame, ordinal: str, hot_rows: int, slab_rows: int) -> DataFrame:
    facts = attach_group(sided, _groups(sided), KEYS, ("__n0__", "__n1__"), "__n__", ordinal, hot_rows, slab_rows)
    return facts.withColumn("__hit__", F.coalesce(_partners() > 0, F.lit(False))).drop("__n0__", "__n1__", SPREAD, HOT)


def _matched_one_to_one(sided: DataFrame, ordinal: str, hot_rows: int, slab_rows: int,
                        df: DataFrame, config: ReversalConfig) -> DataFrame:
    pairs = reversal_pairs_one_to_one(df, config, ordinal, hot_rows, slab_rows)
    used = pairs.select(F.explode(F.array("row_i", "row_j")).alias(ordinal)).withColumn("__used__", F.lit(True))
    return sided.join(used, ordinal, "left").withColumn("__hit__", F.col("__used__").isNotNull()).drop("__used__")


def _limit(config: ReversalConfig) -> Decimal:
    """The tolerance in whole billionths."""
    return Decimal(int(config.tolerance / UNIT + 1e-6)).scaleb(-AMOUNT_SCALE)


def _on_a_line(sided: DataFrame, config: ReversalConfig) -> tuple[DataFrame, Column]:
    """Rows with their place ``__x__`` as an exact level, and where they stand: (side, x).

    Two rows of a group reverse each other if they stand on opposite sides at most the tolerance apart.
    Rows whose two keys are equal stand on both sides of their group.
    """
    same_keys = F.col("__low__") == F.col("__high__")
    value = amount(ref(config.value_column), column_type(sided, config.value_column)).cast(LEVEL)
    base = sided.withColumn("__x__", value).withColumns({
        "__x__": F.when((F.col("__side__") == 1) & ~same_keys, -F.col("__x__")).otherwise(F.col("__x__")).cast(LEVEL),
        "__side__": F.when(same_keys, F.lit(0)).otherwise(F.col("__side__")),
    })
    entry = lambda side, x: F.struct(side.alias("side"), x.alias("x"))
    stands = F.when(
        same_keys, F.array(entry(F.lit(0), F.col("__x__")), entry(F.lit(1), (-F.col("__x__")).cast(LEVEL)))
    ).otherwise(F.array(entry(F.col("__side__"), F.col("__x__"))))
    return base, stands


def _partners_within(sided: DataFrame, config: ReversalConfig) -> tuple[DataFrame, DataFrame]:
    """Rows on their line, and per (low, high, x) how many rows stand there and how many within the tolerance, by side."""
    base, stands = _on_a_line(sided, config)
    places = (
        base.where(complete_key(("__low__", "__high__"))).select("__low__", "__high__", F.inline(stands))
        .groupBy("__low__", "__high__", F.col("x").alias("__x__"))
        .agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"))
    )
    return base, sums_within(places, ("__low__", "__high__"), "__x__", ("n0", "n1"), _limit(config))


def _itself(config: ReversalConfig) -> Column:
    """1 where a row whose two keys are equal is its own partner, which does not count."""
    return ((F.col("__low__") == F.col("__high__")) & (F.abs(F.col("__x__")) * 2 <= F.lit(_limit(config)))).cast("int")


def reversal_pairs_within(df: DataFrame, config: ReversalConfig) -> DataFrame:
    """All pairs at any tolerance, run-length encoded: one row per (low, high, level) whose forward rows have partners.

    ``rows_forward`` rows read (low, high, level) and each of them pairs with the same ``partners`` mirrored
    rows, whose levels are at most the tolerance away; ``pairs`` of all rows add up to the pairs there are.
    With equal keys every row is forward and pairs are found from both ends, so a row counts half of them.
    """
    _, places = _partners_within(_sided(df, config), config)
    own = F.col("n0").cast("decimal(19,0)")
    partners = (F.col("within_n1") - _itself(config)).alias("partners")
    whole = own * (F.col("within_n1") - _itself(config))
    pairs = F.when(F.col("__low__") == F.col("__high__"), (whole / 2).cast("decimal(38,1)")).otherwise(whole.cast("decimal(38,1)"))
    return places.select(
        F.col("__low__").alias("low"), F.col("__high__").alias("high"), F.col("__x__").cast("double").alias("level"),
        F.col("n0").alias("rows_forward"), partners, pairs.alias("pairs"),
    ).where((F.col("rows_forward") > 0) & (F.col("partners") > 0))


def _counts_within(df: DataFrame, config: ReversalConfig) -> DataFrame:
    _, places = _partners_within(_sided(df, config), config)
    same_keys = F.col("__low__") == F.col("__high__")
    forward = F.col("within_n1") - _itself(config)
    wide = lambda c: c.cast("decimal(38,0)")
    pairs = F.sum(F.when(~same_keys, wide(F.col("n0")) * F.col("within_n1")))
    half = F.sum(F.when(same_keys, wide(F.col("n0")) * forward))
    marked = F.when(forward > 0, F.col("n0")).otherwise(0) + F.when(~same_keys & (F.col("within_n0") > 0), F.col("n1")).otherwise(0)
    return places.agg(
        # from both ends each pair of equal keys is counted twice
        (F.coalesce(pairs, F.lit(0)) + (F.coalesce(half, F.lit(0)) / 2).cast("decimal(38,0)")).cast("decimal(38,0)").alias("reversals"),
        F.coalesce(F.sum(marked), F.lit(0)).alias("rows_marked"))


def _matched_within(sided: DataFrame, df: DataFrame, config: ReversalConfig, ordinal: str,
                    hot_rows: int, slab_rows: int) -> DataFrame:
    """Rows with a partner whose value is off by at most a tolerance wider than one unit.

    Levels are cut into buckets one unit wider than the tolerance and centred on
    zero: all levels of one bucket match each other, levels two buckets apart never
    do, and in a neighbouring bucket the nearest level decides. So counts and
    extremes per bucket are enough and no pair is ever built.
    """
    limit = _limit(config)
    width = limit + Decimal(1).scaleb(-AMOUNT_SCALE)
    keys = ("__low__", "__high__", "__bucket__")
    same_keys = F.col("__low__") == F.col("__high__")

    def bucket(x: Column) -> Column:
        shifted = x.cast("decimal(30,10)") + F.lit(width / 2)
        return (shifted - F.pmod(shifted, F.lit(width))).cast(LEVEL)

    base, stands = _on_a_line(sided, config)
    cells = (
        base.where(complete_key(keys[:2]))
        .select("__low__", "__high__", F.inline(stands))
        .withColumn("__bucket__", bucket(F.col("x")))
        .groupBy(*keys).agg(*[
            agg(F.when(F.col("side") == s, F.col("x"))).alias(f"__{name}{s}__")
            for s in (0, 1) for name, agg in (("n", F.count), ("min", F.min), ("max", F.max))
        ])
    )
    # each cell is seen by its own bucket (0), the one below (-1) and the one above (1)
    views = F.array(*[
        F.struct((F.col("__bucket__") + F.lit(width * k)).cast(LEVEL).alias("__bucket__"), F.lit(k).alias("k"))
        for k in (-1, 0, 1)
    ])
    seen = lambda k, name: F.max(F.when(F.col("k") == k, F.col(name)))
    stats = [F.col(f"__{name}{s}__") for name in ("n", "min", "max") for s in (0, 1)]
    groups = (
        cells.select("__low__", "__high__", *stats, F.inline(views)).where(complete_key(keys))
        .groupBy(spread_of(keys).alias(SPREAD), *keys)
        .agg(*[seen(0, f"__n{s}__").alias(f"__n{s}__") for s in (0, 1)],
             *[seen(1, f"__max{s}__").alias(f"__below{s}__") for s in (0, 1)],
             *[seen(-1, f"__min{s}__").alias(f"__above{s}__") for s in (0, 1)])
        .withColumn("__n__", F.coalesce("__n0__", F.lit(0)) + F.coalesce("__n1__", F.lit(0)))
    )
    facts = tuple(f"__{name}{s}__" for name in ("n", "below", "above") for s in (0, 1))
    found = attach_group(base.withColumn("__bucket__", bucket(F.col("__x__"))), groups, keys, facts, "__n__", ordinal,
                         hot_rows, slab_rows)
    other = lambda name: F.when(F.col("__side__") == 0, F.col(f"__{name}1__")).otherwise(F.col(f"__{name}0__"))
    itself = (same_keys & (F.abs(F.col("__x__")) <= F.lit(limit / 2))).cast("int")
    hit = (
        (F.coalesce(other("n"), F.lit(0)) - itself > 0)
        | F.coalesce(other("above") - F.col("__x__") <= F.lit(limit), F.lit(False))
        | F.coalesce(F.col("__x__") - other("below") <= F.lit(limit), F.lit(False))
    )
    return found.withColumn("__hit__", hit & F.col("__low__").isNotNull()).drop(*facts, SPREAD, HOT, "__x__", "__bucket__")


def mark_reversals(df: DataFrame, config: ReversalConfig, ordinal: str = "row_index",
                   hot_rows: int = HOT_ROWS, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """``df`` with ``__is_reversal__``; a flag that is already set stays set."""
    require(df, ordinal)
    sided = _sided(df, config)
    if config.mode == "one_to_one":
        matched = _matched_one_to_one(sided, ordinal, hot_rows, slab_rows, df, config)
    elif config.mode != "all_pairs":
        raise ValueError(f"unknown reversal mode: {config.mode}")
    elif config.tolerance <= UNIT:
        matched = _matched_all_pairs(sided, ordinal, hot_rows, slab_rows)
    else:
        matched = _matched_within(sided, df, config, ordinal, hot_rows, slab_rows)
    flag = F.col("__hit__")
    if REVERSAL_FLAG in df.columns:
        flag = F.coalesce(ref(REVERSAL_FLAG).cast("boolean"), F.lit(False)) | flag
    others = [ref(c) for c in df.columns if c != REVERSAL_FLAG]
    return matched.select(*others, flag.alias(REVERSAL_FLAG))


def _stackable(config: ReversalConfig) -> bool:
    return config.mode == "all_pairs" and config.tolerance is not None and 0 <= config.tolerance <= UNIT


def _stacked_hits(df: DataFrame, configs: Sequence[tuple[int, ReversalConfig]], ordinal: str,
                  hot_rows: int, slab_rows: int) -> DataFrame:
    """(config, row) of every row with a partner, for all configurations in one pass.

    Each row stands once for each configuration, tagged with it, and one aggregation counts the groups of all.
    """
    keyed = df.select(ref(ordinal).alias("__row__"), *[ref(c) for c in dict.fromkeys(
        name for _, c in configs for name in (c.column_a, c.column_b, c.value_column))])
    entries = []
    for i, config in configs:
        text = lambda name: F.when(ref(name).isNotNull(), key_part(ref(name), column_type(df, name)))
        names = (f"__a{i}__", f"__b{i}__", f"__v{i}__")
        keyed = keyed.withColumns(dict(zip(names, (text(config.column_a), text(config.column_b), _value(df, config.value_column).cast("double")
                                                   if not isinstance(column_type(df, config.value_column), T.DecimalType)
                                                   else _value(df, config.value_column)))))
        a, b, v = map(F.col, names)
        flipped = (a > b) | ((a == b) & (v < 0))
        complete = a.isNotNull() & b.isNotNull()
        units, nanos = _whole_and_nano(F.when(flipped, -v).otherwise(v))
        entries.append(F.struct(
            F.lit(i).alias("__config__"), F.when(complete, F.least(a, b)).alias("__low__"), F.when(complete, F.greatest(a, b)).alias("__high__"),
            units.alias("__units__"), nanos.alias("__nanos__"), flipped.cast("int").alias("__side__")))
    keys = ("__config__", *KEYS)
    tagged = keyed.select("__row__", F.inline(F.array(*entries))).where(F.col("__low__").isNotNull())
    groups = (
        tagged.where(complete_key(keys)).groupBy(spread_of(keys).alias(SPREAD), *keys)
        .agg(F.count_if(F.col("__side__") == 0).alias("__n0__"), F.count_if(F.col("__side__") == 1).alias("__n1__"))
        .withColumn("__n__", F.col("__n0__") + F.col("__n1__"))
    )
    facts = attach_group(tagged, groups, keys, ("__n0__", "__n1__"), "__n__", "__row__", hot_rows, slab_rows)
    return facts.where(_partners() > 0).select(F.col("__config__").alias("config"), F.col("__row__").alias("row"))


def reversal_hits(df: DataFrame, configs: Sequence[ReversalConfig], ordinal: str = "row_index",
                  hot_rows: int = HOT_ROWS, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """(config, row): the position of a configuration and the ordinal of a row that it finds a partner for.

    Configurations that pair all rows at nine places share one pass over the rows; others take one each.
    """
    require(df, ordinal)
    if not configs:
        return df.select(F.lit(0).alias("config"), ref(ordinal).alias("row")).where("false")
    for config in configs:
        require(df, config.column_a, config.column_b, config.value_column)
    together = [(i, c) for i, c in enumerate(configs) if _stackable(c)]
    found = [_stacked_hits(df, together, ordinal, hot_rows, slab_rows)] if together else []
    for i, config in enumerate(configs):
        if not _stackable(config):
            own = list(dict.fromkeys((ordinal, config.column_a, config.column_b, config.value_column)))
            marked = mark_reversals(df.select(*[ref(c) for c in own]), config, ordinal, hot_rows, slab_rows)
            found.append(marked.where(ref(REVERSAL_FLAG)).select(F.lit(i).alias("config"), ref(ordinal).alias("row")))
    return reduce(DataFrame.unionByName, found)


def mark_all_reversals(df: DataFrame, configs: Sequence[ReversalConfig], ordinal: str = "row_index",
                       hot_rows: int = HOT_ROWS, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """``df`` with ``__is_reversal__`` set where any configuration finds a partner; a set flag stays set.

    Every configuration looks at the same rows, in one pass, and only the ordinals found meet the others.
    """
    if len(configs) == 1:
        return mark_reversals(df, configs[0], ordinal, hot_rows, slab_rows)
    hits = reversal_hits(df, configs, ordinal, hot_rows, slab_rows).select(F.col("row").alias("__row__")).distinct()
    flag = F.col("__hit__").isNotNull()
    if REVERSAL_FLAG in df.columns:
        flag = F.coalesce(ref(REVERSAL_FLAG).cast("boolean"), F.lit(False)) | flag
    others = [ref(c) for c in df.columns if c != REVERSAL_FLAG]
    found = df.join(hits.withColumn("__hit__", F.lit(True)), ref(ordinal) == F.col("__row__"), "left")
    return found.select(*others, flag.alias(REVERSAL_FLAG))


def reversal_counts(df: DataFrame, config: ReversalConfig, ordinal: str = "row_index") -> DataFrame:
    """One row: ``reversals`` (pairs) and ``rows_marked`` (distinct rows in them)."""
    if config.mode == "one_to_one":
        pairs = reversal_pairs_one_to_one(df, config, ordinal)
        return pairs.agg(F.count("*").alias("reversals"), (F.count("*") * 2).alias("rows_marked"))
    if config.tolerance > UNIT:
        return _counts_within(df, config)
    both = F.col("rows_forward") + F.col("rows_mirrored")
    return reversal_pairs(df, config).agg(
        F.coalesce(F.sum("pairs"), F.lit(0)).cast("decimal(38,0)").alias("reversals"),
        F.coalesce(F.sum(both), F.lit(0)).alias("rows_marked"),
    )


def reversal_results(marked: DataFrame, run_id: int, dataset_id: int, ordinal: str = "row_index") -> DataFrame:
    """One result record per flagged row, in the shape of the results table."""
    return _records(marked.where(ref(REVERSAL_FLAG)), F.lit(run_id), dataset_id, ref(ordinal))


def _records(rows: DataFrame, run_id: Column, dataset_id: int, ordinal: Column) -> DataFrame:
    return rows.select(
        run_id.cast("bigint").alias("run_id"),
        F.lit(dataset_id).cast("bigint").alias("dataset_id"),
        ordinal.cast("string").alias("row_identifier"),
        F.lit(REVERSAL_STATUS).alias("status"),
        F.lit(REVERSAL_GROUP).alias("group_name"),
        F.lit(None).cast("string").alias("key_used"),
        F.lit(0.0).alias("difference"),
    )


def reversal_hit_results(hits: DataFrame, run_ids: Sequence[int], dataset_id: int) -> DataFrame:
    """Result records of ``reversal_hits``; configuration i belongs to run ``run_ids[i]``."""
    runs = F.array(*[F.lit(r).cast("bigint") for r in run_ids])
    return _records(hits, F.get(runs, F.col("config")), dataset_id, F.col("row"))
