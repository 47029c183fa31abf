"""Jobs composed from a structured spec: sources, steps, rules, outputs and checks.

A spec names its fields explicitly (``on``, ``how``, ``predicate``, ``expression``); building
a job only chains DataFrame operations. Spark runs where a stage with checks is written and
validated, where a model is trained, and at the final write.

Outputs are published: each is written once, next to its path, while the global checks are counted
by that write; only when they pass do the new tables take their places. A job that stops leaves
what was there before.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.storagelevel import StorageLevel

from millrace.operators import columns as cols
from millrace.operators.catalog import (
    mentioned_columns,
    missing_columns,
    parse_specs,
    spec_sources,
)
from millrace.operators.checks import (
    RESULT_SCHEMA,
    Check,
    Measured,
    Suite,
    enforce,
    keep_version,
    latest_suite,
    measure,
    watch,
)
from millrace.functions.types import has_type, quoted, type_of
from millrace.operators.impute import IMPUTED_SCHEMA, impute, warn_skipped
from millrace.operators.joins import join_tables
from millrace.operators.model import placeholder_score, score, to_score
from millrace.operators.stats import aggregate
from millrace.plans.liveness import ALL, Needed, live_columns
from millrace.sources.readers import load_sources, read_csv_sorted, read_table
from millrace.sources.scratch import beside, discard, new_path, remove, swap
from millrace.sources.writers import write_counted, write_report, write_table

STEP_TYPES = ("join", "filter", "aggregation", "column_manipulation")
RULE_TYPES = ("condition", "calculation", "domain_logic")
_WIDE_STEPS = ("join", "aggregation")
OUTPUT_TYPES = ("scoring_model", "format", "metadata")


def _checks(spec: Mapping[str, Any], name: str = "data_quality_checks") -> tuple[Check, ...]:
    return tuple(Check.from_dict(c) for c in spec.get(name) or ())


@dataclass(frozen=True)
class Step:
    """One transformation: its type, input tables, output name, arguments and checks."""

    type: str
    inputs: tuple[str, ...]
    output: str
    arguments: Mapping[str, Any] = field(default_factory=dict)
    checks: tuple[Check, ...] = ()

    def __post_init__(self) -> None:
        if self.type not in STEP_TYPES:
            raise ValueError(f"step type {self.type!r} is not one of {', '.join(STEP_TYPES)}")

    @classmethod
    def from_dict(cls, spec: Mapping[str, Any], previous: str) -> Step:
        inputs = spec.get("inputs") or [previous]
        own = {"type", "inputs", "output_table_name", "data_quality_checks", "details"}
        arguments = {k: v for k, v in spec.items() if k not in own}
        output = spec.get("output_table_name") or previous
        return cls(spec["type"], tuple(inputs), output, arguments, _checks(spec))


@dataclass(frozen=True)
class Rule:
    """A business rule on the current table: a condition, a calculation or cases."""

    type: str
    arguments: Mapping[str, Any]

    def __post_init__(self) -> None:
        if self.type not in RULE_TYPES:
            raise ValueError(f"rule type {self.type!r} is not one of {', '.join(RULE_TYPES)}")

    @classmethod
    def from_dict(cls, spec: Mapping[str, Any]) -> Rule:
        return cls(spec["type"], {k: v for k, v in spec.items() if k not in ("type", "details")})


@dataclass(frozen=True)
class Output:
    """What happens to the final table: scoring, extra columns, projection or a write."""

    type: str
    input: str | None = None
    output: str | None = None
    arguments: Mapping[str, Any] = field(default_factory=dict)
    checks: tuple[Check, ...] = ()

    def __post_init__(self) -> None:
        if self.type not in OUTPUT_TYPES:
            raise ValueError(f"output type {self.type!r} is not one of {', '.join(OUTPUT_TYPES)}")

    @classmethod
    def from_dict(cls, spec: Mapping[str, Any]) -> Output:
        own = {"type", "details", "input_table_name", "output_table_name", "data_quality_checks"}
        arguments = {k: v for k, v in spec.items() if k not in own}
        names = spec.get("input_table_name"), spec.get("output_table_name")
        return cls(spec["type"], *names, arguments, _checks(spec))


@dataclass(frozen=True)
class Spec:
    """A whole job."""

    sources: tuple[str, ...]
    steps: tuple[Step, ...]
    rules: tuple[Rule, ...] = ()
    outputs: tuple[Output, ...] = ()
    global_checks: tuple[Check, ...] = ()

    @classmethod
    def from_dict(cls, spec: Mapping[str, Any]) -> Spec:
        sources = tuple(s["name"] for s in spec["source"])
        steps, previous = [], sources[0]
        for entry in spec.get("transformation") or ():
            step = Step.from_dict(entry, previous)
            steps.append(step)
            previous = step.output
        return cls(
            sources,
            tuple(steps),
            tuple(Rule.from_dict(r) for r in spec.get("business_rules") or ()),
            tuple(Output.from_dict(o) for o in spec.get("output") or ()),
            _checks(spec, "global_data_quality_checks"),
        )

    @classmethod
    def from_json(cls, text: str) -> Spec:
        return cls.from_dict(json.loads(text))


@dataclass(frozen=True)
class JobResult:
    """The final table, every named table, the results of all checks and the stage log.

    ``imputed`` says of every column that an imputation looked at how many values it missed,
    what filled them, or why it was left alone. ``release`` deletes or unpersists what the job
    staged, so call it when done with the tables.
    """

    data: DataFrame
    tables: Mapping[str, DataFrame]
    results: DataFrame
    log: DataFrame
    warnings: Sequence[Row]
    release: Callable[[], None]
    imputed: DataFrame


class Stages:
    """Checks tables, materializes those worth it, and keeps the log of what each one held.

    ``how`` is "table" (Parquet in the shared folder: survives lost executors and is read
    column by column), "persist" (memory and disk of the executors) or None.

    A table that is read more than once (checked, imputed) is materialized when its plan
    has a join, an aggregation or a model since the last materialized table. Its rows, nulls
    and row-wise checks are then counted by the write itself. Otherwise it is a narrow step on
    top of a materialized table or a source, and checking it reads just the checked columns.
    """

    def __init__(self, spark: SparkSession, how: str | None, suite_store: str | None = None) -> None:
        if how not in ("table", "persist", None):
            raise ValueError(f"cannot stage by {how!r}")
        self.spark = spark
        self.how = how
        self.suite_store = suite_store
        self.results: list[Row] = []
        self.warnings: list[Row] = []
        self.missing: dict[str, dict[str, int]] = {}
        self.costly: set[str] = set()
        self._log: list[tuple[int, str, int, str]] = []
        self._persisted: list[DataFrame] = []
        self._written: list[str] = []
        self.imputed: list[Row] = []

    def made(self, name: str, inputs: Sequence[str], wide: bool) -> None:
        """Note a table that a step has produced from others."""
        self.missing.pop(name, None)
        if wide or any(i in self.costly for i in inputs):
            self.costly.add(name)
        else:
            self.costly.discard(name)

    def check(
        self, df: DataFrame, name: str, checks: Sequence[Check], live: Needed = ALL
    ) -> DataFrame:
        """Validate a table, keep the results, and stop the job on a critical failure.

        A table that is materialized keeps its live columns only.
        """
        suite = self.suite(name, checks)
        if self.how and name in self.costly:
            df, measured = self._materialize(live_part(df, live), name, suite)
        else:
            measured = measure(df, suite)
        self.judge(df, name, measured)
        return df

    def suite(self, name: str, checks: Sequence[Check]) -> Suite:
        """The suite of a table; with a store, its latest version there."""
        suite = Suite(f"{name}_suite", checks)
        if self.suite_store is None or not checks:
            return suite
        keep_version(self.spark, suite, self.suite_store)
        return latest_suite(self.spark, suite.name, self.suite_store)

    def note(self, stage: str, rows: int, schema: str) -> None:
        self._log.append((len(self._log), stage, rows, schema))

    def judge(self, df: DataFrame, name: str, measured: Measured) -> None:
        """Log a measured table, keep its results, and stop the job on a critical failure."""
        self.note(name, measured.rows, df.schema.simpleString())
        results = measured.results(df).collect()
        self.results += results
        self.warnings += enforce(results)

    def keep(self, df: DataFrame, name: str, live: Needed = ALL) -> DataFrame:
        """Materialize the live columns of a costly table that is about to be read more than once."""
        if not self.how or name not in self.costly:
            return df
        df, measured = self._materialize(live_part(df, live), name, Suite(name))
        self.note(name, measured.rows, df.schema.simpleString())
        return df

    def _materialize(self, df: DataFrame, name: str, suite: Suite) -> tuple[DataFrame, Measured]:
        if self.how == "table":
            watched = watch(df, suite)
            path = new_path(self.spark, name)
            self._written.append(path)
            write_table(watched.data, path)
            kept = self.spark.read.schema(df.schema).parquet(path)
        else:
            kept = df.persist(StorageLevel.MEMORY_AND_DISK)
            self._persisted.append(kept)
            watched = watch(kept, suite)
            watched.data.write.format("noop").mode("overwrite").save()
        measured = watched.measured()
        self.costly.discard(name)
        self.missing[name] = measured.missing(kept.columns)
        return kept, measured

    def log(self) -> DataFrame:
        """One row per checked table: position, stage, rows and schema."""
        return self.spark.createDataFrame(
            self._log, "position int, stage string, rows bigint, schema string"
        )

    def all_results(self) -> DataFrame:
        return self.spark.createDataFrame(self.results, RESULT_SCHEMA)

    def release(self) -> None:
        for df in self._persisted:
            df.unpersist()
        self._persisted.clear()
        for path in self._written:
            remove(self.spark, path)
        self._written.clear()

    def all_imputed(self) -> DataFrame:
        return self.spark.createDataFrame(self.imputed, IMPUTED_SCHEMA)


def live_part(df: DataFrame, live: Needed) -> DataFrame:
    """The columns of a table that are still needed; one at least, so that its rows count."""
    columns = live.columns(df.columns) or df.columns[:1]
    return df if len(columns) == len(df.columns) else df.select(*map(quoted, columns))


def publish(
    stages: Stages,
    outputs: Sequence[tuple[DataFrame, str, str]],
    final: DataFrame,
    checks: Sequence[Check],
) -> DataFrame:
    """Write every output, as (table, path, format), next to its path; check; put all in place.

    Where the final table is among them, its rows and the row-wise checks are counted by its write,
    so its plan runs once; checks that need a grouping read the written table. Otherwise the checks
    are measured as on any table. Returns the final table, read from what was written if it was
    written as Parquet. When a check fails, or a write, the old tables stay as they were.
    """
    spark, suite = stages.spark, stages.suite("global", checks)
    watched, last = None, None
    written: list[tuple[str, str]] = []
    try:
        for df, path, fmt in outputs:
            aside = beside(path)
            written.append((aside, path))
            if df is final and last is None:
                last = (aside, path, fmt)
                if checks:
                    watched = watch(df, suite)
                    df = watched.data
            write_table(df, aside, fmt)
        if checks:
            if watched is not None and last is not None:
                read = read_table(spark, last[0], last[2], schema=final.schema)
                stages.judge(read, "global", watched.measured())
            else:
                final = stages.check(final, "global", checks)
        for aside, path in written:
            swap(spark, aside, path)
    finally:
        for aside, _ in written:
            discard(spark, aside)
    if last is not None and last[2] == "parquet":
        return read_table(spark, last[1], schema=final.schema)
    return final


# --- the operations a spec can name --------------------------------------------------------


def _impute(
    df: DataFrame,
    operation: Mapping[str, Any],
    keep: Sequence[str],
    missing: Mapping[str, int] | None,
    imputed: list[Row] | None,
) -> DataFrame:
    name = operation["operation"]
    numeric = "mean" if name in ("impute_mean", "impute") else None
    categorical = {
        "impute": "mode", "impute_mode": "mode", "impute_constant": "constant"
    }.get(name)
    settings: dict[str, Any] = {"numeric": numeric, "categorical": categorical}
    if "value" in operation:
        settings["value"] = operation["value"]
    done = impute(df, columns=operation.get("columns"), exclude=keep, missing=missing, now=True, **settings)
    warn_skipped(done.log)
    if imputed is not None:
        imputed += done.log.collect()  # a row for each column
    return done.data


_IMPUTATIONS = ("impute", "impute_mean", "impute_mode", "impute_constant")
_OPERATIONS: dict[str, Callable[[DataFrame, Mapping[str, Any]], DataFrame]] = {
    "filter_rows": lambda df, o: cols.filter_rows(df, o["predicate"]),
    "rename_column": lambda df, o: cols.rename_columns(df, o["names"]),
    "cast": lambda df, o: cols.cast_columns(df, o["types"]),
    "derive": lambda df, o: cols.derive(df, o["expressions"]),
    "select": lambda df, o: cols.select_columns(df, o["columns"]),
}


def apply_operations(
    df: DataFrame,
    operations: Sequence[Mapping[str, Any]],
    keep: Sequence[str] = (),
    missing: Mapping[str, int] | None = None,
    imputed: list[Row] | None = None,
) -> DataFrame:
    """Apply named column operations in order; imputation by type leaves ``keep`` alone.

    ``missing`` holds the null counts of ``df`` where they are known. They stop counting
    once an operation other than an imputation has changed the table. ``imputed`` receives
    the log of every imputation. A ``data_type`` declared by an operation is the type its
    columns must have after it.
    """
    for operation in operations:
        name = operation["operation"]
        if name in _IMPUTATIONS:
            df = _impute(df, operation, keep, missing, imputed)
        elif name in _OPERATIONS:
            df = _OPERATIONS[name](df, operation)
            missing = None
        else:
            raise ValueError(f"unknown operation {name!r}")
        _require_type(df, operation)
    return df


def _require_type(df: DataFrame, operation: Mapping[str, Any]) -> None:
    declared = operation.get("data_type")
    if not declared:
        return
    given = operation.get("expressions") or operation.get("types") or operation.get("columns") or ()
    made = (operation.get("names") or {}).values()
    for column in [*given, *made]:
        if not has_type(type_of(df, column), declared):
            held = type_of(df, column).simpleString()
            raise ValueError(
                f"{operation['operation']} declares {column} as {declared}, but it is {held}"
            )


def apply_step(
    step: Step,
    tables: Mapping[str, DataFrame],
    keep: Sequence[str] = (),
    missing: Mapping[str, Mapping[str, int]] | None = None,
    imputed: list[Row] | None = None,
) -> DataFrame:
    given = step.arguments
    inputs = [_table(tables, name) for name in step.inputs]
    if step.type == "join":
        options = {k: given[k] for k in ("align_keys", "broadcast", "salt", "suffix") if k in given}
        return join_tables(*inputs, on=given["on"], how=given.get("how", "inner"), **options)
    if step.type == "filter":
        return cols.filter_rows(inputs[0], given["predicate"])
    if step.type == "aggregation":
        return aggregate(inputs[0], given["by"], given["measures"])
    known = (missing or {}).get(step.inputs[0])
    return apply_operations(inputs[0], given["transformations_details"], keep, known, imputed)


def apply_rule(df: DataFrame, rule: Rule) -> DataFrame:
    given = rule.arguments
    if rule.type == "condition":
        return cols.filter_rows(df, given["predicate"])
    if rule.type == "calculation":
        return cols.derive(df, given["expressions"])
    cases = [(c["when"], c["then"]) for c in given["cases"]]
    return cols.derive_when(df, given["name"], cases, given.get("default"))


def apply_output(
    df: DataFrame, output: Output, models: Mapping[str, PipelineModel]
) -> DataFrame:
    given = output.arguments
    if output.type == "scoring_model":
        name = given.get("name", "score")
        if "model" in given:
            scored = score(df, models[given["model"]])
            return to_score(scored, name, given.get("confidence", False))
        return placeholder_score(df, given["column"], name, given.get("non_negative", False))
    if output.type == "metadata":
        return cols.derive(df, given["expressions"])
    return cols.select_columns(df, given["columns"]) if "columns" in given else df


def _table(tables: Mapping[str, DataFrame], name: str) -> DataFrame:
    if name not in tables:
        raise ValueError(f"no table named {name!r}; known: {', '.join(tables)}")
    return tables[name]


def _imputes(step: Step) -> bool:
    operations = step.arguments.get("transformations_details") or ()
    return any(o["operation"] in _IMPUTATIONS for o in operations)


def _join_keys(spec: Spec) -> list[str]:
    """Join keys: imputation by type leaves them alone."""
    keys: list[str] = []
    for step in spec.steps:
        if step.type == "join":
            on = step.arguments["on"]
            keys += [on] if isinstance(on, str) else on
    return keys


def run_job(
    tables: Mapping[str, DataFrame],
    spec: Spec | Mapping[str, Any],
    models: Mapping[str, PipelineModel] | None = None,
    keep: Sequence[str] = (),
    stage: str | None = "table",
    report_path: str | None = None,
    suite_store: str | None = None,
    rejected: Mapping[str, int] | None = None,
) -> JobResult:
    """Run a job over named tables.

    Steps run in order, then rules and outputs on the last step's table. A table with
    checks is validated before the job goes on; a CRITICAL failure raises, a WARNING is
    logged and kept. ``stage`` says how checked joins and aggregations are materialized;
    ``report_path`` gets the results of all checks that ran, whether the job ends or stops.
    ``keep`` names columns, such as a label, that imputation by type leaves alone, as it
    does the join keys. An output of type "format" with a ``path`` publishes its own table there,
    if the global checks on the last table pass; the last table is then read from there. Tables
    that the job materializes keep only columns that something after them can name. Columns that no imputation could
    fill are logged as warnings.
    """
    if not isinstance(spec, Spec):
        spec = Spec.from_dict(spec)
    absent = [name for name in spec.sources if name not in tables]
    if absent:
        raise ValueError(f"no table for the sources {', '.join(absent)}")
    named = {name: tables[name] for name in spec.sources}
    spark = next(iter(named.values())).sparkSession
    stages = Stages(spark, stage, suite_store)
    for name, rows in (rejected or {}).items():
        stages.note(f"rejected {name}", rows, "record string")
    untouched = [*_join_keys(spec), *keep]
    try:
        current = spec.sources[0]
        # What is needed of each table from the step that is next.
        live: dict[str, Needed] = {}
        for step, needed in zip(spec.steps, live_columns(spec), strict=True):
            if _imputes(step):
                given = step.inputs[0]
                named[given] = stages.keep(_table(named, given), given, live.get(given, ALL))
            df = apply_step(step, named, untouched, stages.missing, stages.imputed)
            current = step.output
            live[current] = needed
            stages.made(current, step.inputs, step.type in _WIDE_STEPS)
            named[current] = stages.check(df, current, step.checks, needed) if step.checks else df
        for rule in spec.rules:
            named[current] = apply_rule(named[current], rule)
            stages.made(current, [current], False)
        made: list[DataFrame] = []
        for output in spec.outputs:
            given = output.input or current
            df = apply_output(_table(named, given), output, models or {})
            current = output.output or given
            stages.made(current, [given], "model" in output.arguments)
            named[current] = stages.check(df, current, output.checks) if output.checks else df
            made.append(named[current])
        stages.made("global", [current], False)
        written = [
            (df, output.arguments["path"], output.arguments.get("fmt", "parquet"))
            for output, df in zip(spec.outputs, made, strict=True)
            if output.type == "format" and "path" in output.arguments
        ]
        named[current] = publish(stages, written, named[current], spec.global_checks)
    except Exception:
        stages.release()
        raise
    finally:
        if report_path and stages.results:
            write_report(stages.all_results(), report_path)
    return JobResult(
        named[current],
        named,
        stages.all_results(),
        stages.log(),
        stages.warnings,
        stages.release,
        stages.all_imputed(),
    )


def made_columns(spec: Mapping[str, Any]) -> set[str]:
    """Columns that a spec says it creates: measures, derived, renamed and scored ones."""
    made: set[str] = set()
    operations = [
        o for s in spec.get("transformation") or () for o in s.get("transformations_details") or ()
    ]
    everything = [
        *(spec.get("transformation") or ()),
        *operations,
        *(spec.get("business_rules") or ()),
        *(spec.get("output") or ()),
    ]
    for entry in everything:
        made.update(entry.get("measures") or ())
        made.update(entry.get("expressions") or ())
        made.update((entry.get("names") or {}).values())
        if isinstance(entry.get("name"), str):
            made.add(entry["name"])
    return made


def audit(spec: Mapping[str, Any], tables: Mapping[str, DataFrame]) -> DataFrame:
    """Columns that a spec mentions, does not create, and finds in none of its sources."""
    spark = next(iter(tables.values())).sparkSession
    stored = spark.createDataFrame([(0, json.dumps(spec))], "id int, spec string")
    specs = parse_specs(stored, "id", "spec")
    mentioned = mentioned_columns(specs).filter(~F.col("column").isin(list(made_columns(spec))))
    columns = [(name, c) for name, df in tables.items() for c in df.columns]
    known = spark.createDataFrame(columns, "table string, column string")
    return missing_columns(mentioned, spec_sources(specs), known).select("column")


def run_files(
    spark: SparkSession,
    base: str,
    spec: Mapping[str, Any],
    fmt: str = "csv",
    schemas: Mapping[str, StructType | str] | None = None,
    reader: Mapping[str, str] | None = None,
    reject_path: str | None = None,
    **settings: Any,
) -> JobResult:
    """As ``run_job``, with the sources read from ``{base}/{name}.{fmt}``.

    ``schemas`` by source spare the inference of CSV types, which reads a file twice;
    ``reader`` holds reader options, such as ``multiLine`` for values with line breaks.
    A source without a file stops the job first, then any mentioned column that no source
    has; all of them are named. With a ``reject_path``, rows of CSV sources that do not fit their
    schema are written to ``{reject_path}/{name}`` and counted in the job's log; the job goes on
    with the others.
    """
    names = [s["name"] for s in spec["source"]]
    tables = load_sources(spark, base, names, fmt, schemas, reader)
    if reject_path is not None:
        if fmt != "csv":
            raise ValueError(f"rows are rejected from CSV sources, not from {fmt}")
        settings["rejected"] = {}
        for name in names:
            found = read_csv_sorted(spark, f"{base}/{name}.csv", tables[name].schema, reader)
            tables[name] = found.data
            settings["rejected"][name] = write_counted(found.rejects, f"{reject_path}/{name}")
    absent = sorted(row["column"] for row in audit(spec, tables).collect())
    if absent:
        raise ValueError(f"no source has the columns {', '.join(absent)}")
    return run_job(tables, spec, **settings)
