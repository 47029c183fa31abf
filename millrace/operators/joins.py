"""Equi-joins on shared key names, with key alignment, checked broadcast and salting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.types import quoted, type_of, wider
from millrace.operators.columns import require_columns

JOIN_TYPES = ("inner", "left", "right", "full", "left_semi", "left_anti")
BROADCAST_BYTES = 64 * 1024 * 1024
BROADCAST_ROWS = 5_000_000
# A key with at least this fraction (1 in so many) of the rows is split when a join is salted.
HOT_KEYS = 1000
# Rows of a key from the left and the right side that meet in a cell of its grid, and pairs that a
# task makes; the cells of a larger grid are dealt to as many tasks as that asks for, up to a bound.
CELL_ROWS = (16_384, 1024)
TASK_PAIRS = 2_000_000
GRID_TASKS = 20_000

# Sides that Spark can broadcast for each join type.
_BROADCAST_SIDES = {
    "inner": ("left", "right"),
    "left": ("right",),
    "right": ("left",),
    "full": (),
    "left_semi": ("right",),
    "left_anti": ("right",),
}


def join_tables(
    left: DataFrame,
    right: DataFrame,
    on: str | list[str],
    how: str = "inner",
    suffix: str = "_right",
    align_keys: bool = False,
    broadcast: str | None = None,
    salt: int | None = None,
) -> DataFrame:
    """Join on key columns that both sides name alike; each key appears once.

    One-to-many matches are all kept and null keys match nothing. Right columns that clash
    with left ones get ``suffix``. Without further arguments Spark picks the strategy, and
    adaptive execution splits skewed partitions of all but full joins; salt a full join whose
    key is skewed.

    ``align_keys``  cast both keys to the wider type first.
    ``broadcast``   "left" or "right": broadcast that side if its measured size is within
                    BROADCAST_BYTES and BROADCAST_ROWS; otherwise the join shuffles.
    ``salt``        split frequent keys over at least this many sub-keys, for keys so frequent that
                    one task cannot hold their matches, on either side; the keys are counted first,
                    and keys frequent on the right are split as far as their matches need.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if how not in JOIN_TYPES:
        raise ValueError(f"join type {how!r} is not one of {', '.join(JOIN_TYPES)}")
    require_columns(left, keys)
    require_columns(right, keys)
    if align_keys:
        left, right = _align(left, right, keys)
    if how in ("left_semi", "left_anti"):
        right = right.select(*map(quoted, keys))
    right = _suffixed(left, right, keys, suffix)
    if salt and salt > 1:
        return _salted_join(left, right, keys, how, salt)
    if broadcast:
        if broadcast not in _BROADCAST_SIDES[how]:
            raise ValueError(f"a {how} join cannot broadcast its {broadcast!r} side")
        if broadcast == "right" and fits_broadcast(right):
            right = F.broadcast(right)
        elif broadcast == "left" and fits_broadcast(left):
            left = F.broadcast(left)
    return left.join(right, keys, how)


def fits_broadcast(
    df: DataFrame, max_bytes: int = BROADCAST_BYTES, max_rows: int = BROADCAST_ROWS
) -> bool:
    """Measure a table in one distributed pass and compare it with the broadcast bound."""
    size = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(_row_bytes(df)), F.lit(0)).alias("bytes"),
    ).first()
    return size["rows"] <= max_rows and size["bytes"] <= max_bytes


def _row_bytes(df: DataFrame) -> Column:
    """Upper estimate of a row's size in memory."""
    total = F.lit(16)
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            total = total + 16 + F.coalesce(F.octet_length(value), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            text = F.to_json(F.struct(value))
            total = total + 32 + F.coalesce(F.octet_length(text), F.lit(0)) * 2
        else:
            total = total + 16
    return total.cast("long")


def _align(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    for key in keys:
        target = wider(type_of(left, key), type_of(right, key))
        if type_of(left, key) != target:
            left = left.withColumn(key, F.col(quoted(key)).cast(target))
        if type_of(right, key) != target:
            right = right.withColumn(key, F.col(quoted(key)).cast(target))
    return left, right


def _suffixed(left: DataFrame, right: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """Right columns that clash with left ones get the suffix, as often as it takes.

    Names clash without regard to case, as Spark resolves them.
    """
    same = {k.lower() for k in keys}
    taken = {c.lower() for c in left.columns}
    free = {c.lower() for c in right.columns}
    names = {}
    for column in right.columns:
        if column.lower() in taken and column.lower() not in same:
            name = column + suffix
            while name.lower() in taken | free:
                name += suffix
            free.add(name.lower())
            names[column] = name
    return right.withColumnsRenamed(names)


_SALT = "__salt"
_TIMES = "__times"
_AGAIN = "__again"
_CELL = "__cell"
_OTHER_TIMES = "__other_times"


def _salted_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str, salt: int
) -> DataFrame:
    """Spread the rows of frequent left keys over ``salt`` sub-keys, copying their right rows.

    Only keys that hold a 1/HOT_KEYS of the left rows or more are split; the others, and right
    rows without such a key, stay single. Salts are hashes of rows, not random numbers, so a
    task that runs again after an executor is lost puts every row where it was. Equal rows of a
    frequent key become one row with a count; the count is dealt to the sub-keys and the rows
    are repeated after the join. Keys frequent on the right are dealt on that side too, in a grid
    whose size follows the rows of the key on both sides: what such a key costs is its pairs, and
    those can be many where the rows themselves would fit one task.
    """
    if how == "right":
        rest = [quoted(c) for c in left.columns if c not in keys]
        other = [quoted(c) for c in right.columns if c not in keys]
        swapped = _salted_join(right, left, keys, "left", salt)
        return swapped.select(*[quoted(k) for k in keys], *rest, *other)
    if how == "full":
        matched = _salted_join(left, right, keys, "left", salt)
        unmatched = _salted_join(right, left.select(*map(quoted, keys)), keys, "left_anti", salt)
        return matched.unionByName(unmatched, allowMissingColumns=True)
    kinds = [wider(type_of(left, k), type_of(right, k)) for k in keys]
    hashed = F.xxhash64(*[F.col(quoted(k)).cast(t) for k, t in zip(keys, kinds, strict=True)])
    hot = hot_keys(left, hashed)
    if how in ("left_semi", "left_anti"):
        right, wide = right.distinct(), []
    else:
        wide = hot_keys(right, hashed)
    if not wide:
        return _one_sided(left, right, keys, how, salt, hashed, hot)
    on_right = hashed.isin(wide)
    rest = _one_sided(
        left.filter(~on_right), right.filter(~on_right), keys, how, salt, hashed, [h for h in hot if h not in wide]
    )
    own, across = left.filter(on_right), right.filter(on_right)
    sizes = [_rows_by_key(side, hashed) for side in (own, across)]
    axes = [
        {h: _parts(n.get(h, 0), most, salt if least is None or h in least else 1) for h in wide}
        for n, most, least in zip(sizes, CELL_ROWS, (set(hot), None), strict=True)
    ]
    both = [h for h in wide if axes[0][h] > 1]
    both = hashed.isin(both) if both else F.lit(False)
    dealt = _grid(own, across, both, salt, *[_by_hash(hashed, axis) for axis in axes])
    cells = sum(axes[0][h] * axes[1][h] for h in wide)
    pairs = sum(sizes[0].get(h, 0) * sizes[1].get(h, 0) for h in wide)
    joined = _joined_cells(*dealt, [*keys, _SALT, _CELL], min(cells, pairs // TASK_PAIRS, GRID_TASKS))
    joined = joined.drop(_SALT, _CELL)
    if how == "left":
        # Of these keys only those of another key with the same hash, and nulls, match nothing.
        known = right.filter(on_right).select(*map(quoted, keys)).distinct()
        joined = joined.unionByName(own.join(known, keys, "left_anti"), allowMissingColumns=True)
    return rest.unionByName(joined.select(*map(quoted, rest.columns)))


def _one_sided(
    left: DataFrame, right: DataFrame, keys: list[str], how: str, salt: int, hashed: Column, hot: list[int]
) -> DataFrame:
    """Deal the left rows of frequent keys; right rows of those keys are copied."""
    if not hot:
        return left.join(right, keys, how)
    frequent = hashed.isin(hot)
    single = right.withColumn(_SALT, F.lit(0).cast("long")).filter(~frequent)
    copied = single.unionByName(right.filter(frequent).withColumn(_SALT, _copies(salt)))
    joined = salted(left, frequent, salt).join(copied, [*keys, _SALT], how)
    return _repeated(joined, _TIMES).drop(_SALT)


def _copies(number: int | Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), (F.lit(number) - 1).cast("long")))


def _rows_by_key(df: DataFrame, hashed: Column) -> dict[int, int]:
    """Rows of each key by its hash, for a table that holds at most HOT_KEYS hashes."""
    counts = df.groupBy(hashed.alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
    return {row["__key"]: row["__n"] for row in counts.collect()}


def _parts(rows: int, most: int, least: int) -> int:
    """Parts of about ``most`` rows, ``least`` or a power of two, so that few numbers occur."""
    return max(least, 1 << max(0, -(-rows // most) - 1).bit_length())


def _by_hash(hashed: Column, numbers: dict[int, int]) -> Column:
    """The number of each hash as an expression; other hashes have 1."""
    found = F.lit(1).cast("long")
    for number in sorted(set(numbers.values()) - {1}):
        hashes = [h for h, n in numbers.items() if n == number]
        found = F.when(hashed.isin(hashes), F.lit(number).cast("long")).otherwise(found)
    return found


def _joined_cells(left: DataFrame, right: DataFrame, on: list[str], tasks: int) -> DataFrame:
    """Join the cells of a grid in so many tasks.

    Adaptive execution sizes tasks by the bytes they read, which say nothing of the pairs they make,
    so the number is set here. Equal rows travel as one and are repeated where they are joined, a
    cell's share of them, not once more for each pair. The merge join goes through the few right rows of a cell for one left
    row after another: equal values stand together or come again soon, which files encode in few bytes.
    """
    names = [quoted(c) for c in on]
    if tasks > 1 and all(type_of(left, c) == type_of(right, c) for c in on):
        left, right = left.repartition(tasks, *names), right.repartition(tasks, *names)
    left, right = _repeated(left, _TIMES), _repeated(right, _OTHER_TIMES)
    return left.hint("merge").join(right.hint("merge"), on)


def _repeated(df: DataFrame, *counts: str) -> DataFrame:
    """Every row as often as the product of its counts says."""
    for name in counts:
        again = F.explode(F.sequence(F.lit(1).cast("long"), F.col(name)))
        df = df.withColumn(_AGAIN, again).drop(name, _AGAIN)
    return df


def _grid(
    left: DataFrame,
    right: DataFrame,
    both: Column,
    salt: int,
    rows: Column | None = None,
    columns: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rows of keys frequent on the right, dealt on both axes of a grid of sub-keys.

    A right row goes to one of ``columns`` columns. Where the key is frequent on the left too
    (``both``), a left row goes to one of ``rows`` rows of the grid and to all its columns, and a
    right row to all rows of its column: each pair meets in one cell. Otherwise the grid has one row.
    Both numbers follow the key and are ``salt`` unless given.
    """
    rows = F.when(both, F.lit(salt) if rows is None else rows).otherwise(F.lit(1)).cast("long")
    columns = F.lit(salt).cast("long") if columns is None else columns
    dealt = salted(left, both, rows).withColumn(_CELL, _copies(columns))
    across = salted(right, F.lit(True), columns).withColumnsRenamed({_SALT: _CELL, _TIMES: _OTHER_TIMES})
    return dealt, across.withColumn(_SALT, _copies(rows))


def hot_keys(df: DataFrame, hashed: Column, share: int = HOT_KEYS) -> list[int]:
    """Hashes of the keys that hold at least a ``share``-th of the rows: at most ``share``.

    One grouping that combines on the map side; the number of all rows is observed on its way.
    """
    whole = Observation()
    counts = df.groupBy(hashed.alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.observe(whole, F.sum("__n").alias("rows"))
    frequent = counts.filter("__n > 1").orderBy(F.desc("__n"), "__key").limit(share).collect()
    least = (whole.get["rows"] or 0) // share if frequent else 0
    return [row["__key"] for row in frequent if row["__n"] >= least]


def salted(df: DataFrame, frequent: Column, salt: int | Column) -> DataFrame:
    """``df`` with a salt and how many equal rows a row stands for.

    Rows that are not frequent have the salt 0 and stand for themselves.
    """
    rest = df.filter(~frequent).withColumns(
        {_SALT: F.lit(0).cast("long"), _TIMES: F.lit(1).cast("long")}
    )
    columns = [F.col(quoted(c)) for c in df.columns]
    counted = df.filter(frequent).groupBy(*columns).agg(F.count(F.lit(1)).alias(_TIMES))
    parts = F.least(F.col(_TIMES), F.lit(salt).cast("long"))
    dealt = counted.withColumn(_AGAIN, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    more = (F.col(_AGAIN) < F.col(_TIMES) % parts).cast("long")
    times = ((F.col(_TIMES) - F.col(_TIMES) % parts) / parts).cast("long") + more
    place = F.pmod(F.xxhash64(*_hashable(df)), F.lit(salt)) + F.col(_AGAIN)
    spread = dealt.withColumns({_SALT: F.pmod(place, F.lit(salt)), _TIMES: times})
    return rest.unionByName(spread.drop(_AGAIN))


def _hashable(df: DataFrame) -> list[str]:
    return [quoted(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
