"""Names of a catalog found in texts, whatever characters they are made of.

Tokens of a fixed pattern miss names with digits, spaces or dots. Here the names themselves are
looked for: an automaton over all of them (Aho-Corasick) reads each text once, however many names
there are. A name counts where no letter, digit or underscore touches it.

The names are measured before they are broadcast. Beyond ``NAME_BYTES`` they are dealt into blocks of
about that size by their hash; every block has an automaton of its own and all of them read the
text in the same pass, so the result is the same.

Defined cases: null and empty texts and names match nothing; letters count as they are written;
repeated names count once; names inside longer names are found where they stand alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.types import quoted

#: Bytes of names, as UTF-8, in one automaton. It takes some dozen times as much memory.
NAME_BYTES = 16 << 20

_AUTOMATA: dict[str, ahocorasick.Automaton] = {}


def automaton_of(names: Sequence[str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for name in names:
        made.add_word(name, name)
    made.make_automaton()
    return made


def _automaton(shared: Broadcast) -> ahocorasick.Automaton:
    """The automaton of a block of names, built once in a worker."""
    label, names = shared.value
    if label not in _AUTOMATA:
        _AUTOMATA[label] = automaton_of(names)
    return _AUTOMATA[label]


def names_in(text: str | None, automaton: ahocorasick.Automaton) -> list[str]:
    """The distinct names that stand alone in a text, in order."""
    found: set[str] = set()
    if text:
        for last, name in automaton.iter(text):
            first = last - len(name) + 1
            before, after = text[first - 1 : first] if first else "", text[last + 1 : last + 2]
            if not (before.isalnum() or before == "_" or after.isalnum() or after == "_"):
                found.add(name)
    return sorted(found)


def _matched(text: Column, shared: Broadcast) -> Column:
    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        automaton = _automaton(shared)
        return pd.Series([names_in(t, automaton) for t in texts], index=texts.index, dtype=object)

    return found(text)


def blocks_of(names: DataFrame, size: int) -> list[list[str]]:
    """Distinct names of the one column ``name`` in blocks of about ``size`` bytes; each is collected."""
    whole = names.agg(F.sum(F.octet_length("name")).alias("bytes")).first()["bytes"] or 0
    number = max(1, -(-whole // size))
    block = F.pmod(F.xxhash64("name"), F.lit(number))
    dealt = ([r["name"] for r in names.filter(block == k).collect()] for k in range(number if whole else 0))
    return [names for names in dealt if names]


def match_names(
    df: DataFrame, column: str, catalog: DataFrame, name: str = "column", into: str = "names", size: int = NAME_BYTES
) -> DataFrame:
    """Add ``into``: the names of ``catalog`` that occur in a text column of ``df``, in order."""
    names = catalog.select(F.col(quoted(name)).alias("name")).filter("name <> ''").distinct()
    blocks: Sequence[list[str]] = blocks_of(names, size)
    text = F.col(quoted(column))
    if not blocks:
        return df.withColumn(into, F.array().cast("array<string>"))
    context = df.sparkSession.sparkContext
    parts = [_matched(text, context.broadcast((uuid.uuid4().hex, block))) for block in blocks]
    return df.withColumn(into, parts[0] if len(parts) == 1 else F.array_sort(F.concat(*parts)))
