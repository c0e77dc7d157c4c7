"""Governed ad-hoc SQL: views without masked columns, in one namespace, in a session of their own.

What a query may use is decided by names that resolve, not by its text: the session's function registries hold
only the allowed functions, its catalog only the governed views, and files are not readable as tables. Spark
analyses the query, and the analysed plan is refused if it reads anything else or holds an expression that
needs no registry, such as ``current_date``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_ROWS = 500
# The functions an ad-hoc query may use.
FUNCTIONS = frozenset(
    """abs any_value array_agg array_join array_sort avg btrim ceil ceiling char_length coalesce collect_set concat concat_ws count count_if date date_add date_diff date_format
    date_part date_sub date_trunc datediff datepart dense_rank extract first_value floor greatest if initcap instr lag last_value lead least left length listagg locate lower lpad ltrim max min
    ntile nullif position rank regexp regexp_like replace right rlike round row_number rpad rtrim size split_part startswith stddev stddev_pop stddev_samp string_agg substr substring sum
    timestampdiff to_date to_number trim upper var_pop var_samp variance""".split()
)
#: Operators and CASE are functions to Spark too.
OPERATORS = frozenset("! != % & * + - / < <= <=> <> = == > >= ^ and between case div ilike in isnotnull isnull like mod negative not or positive when | || ~".split())
#: Plan nodes and expressions without an entry in a registry that a query may not use: the clock, the user, the place of a row, scripts.
REFUSED = re.compile(r"^(Current\w+|LocalTimestamp|Now|InputFile\w+|MonotonicallyIncreasingID|SparkPartitionID|ScriptTransformation|\w*Hint)$")


@dataclass(frozen=True)
class GovernedDataset:
    """How to read a dataset, which columns nobody may see and which namespace is admitted."""

    read: Callable[[SparkSession], DataFrame]
    masked: tuple[str, ...] = ()
    namespace: tuple[str, str] | None = None


def _nodes(value) -> Iterator[dict]:
    """Every object of the JSON form of a plan, subqueries included."""
    if isinstance(value, dict):
        yield value
        for v in value.values():
            yield from _nodes(v)
    elif isinstance(value, list):
        for v in value:
            yield from _nodes(v)


@dataclass
class GovernedSession:
    """A fresh session whose catalog holds only the governed views, and whose registries only allowed functions."""

    spark: SparkSession
    datasets: Mapping[str, GovernedDataset]
    session: SparkSession = field(init=False)

    def __post_init__(self):
        self.session = self.spark.newSession()
        settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.runSQLOnFiles": "false", "spark.sql.shuffle.partitions": self.spark.conf.get("spark.sql.shuffle.partitions")}
        for key, value in settings.items():
            self.session.conf.set(key, value)
        for name, dataset in self.datasets.items():
            self.view(dataset).createOrReplaceTempView(name)
        state = self.session._jsparkSession.sessionState()
        for registry, allowed in ((state.functionRegistry(), FUNCTIONS | OPERATORS), (state.tableFunctionRegistry(), frozenset())):
            known = registry.listFunction()
            for function in [known.apply(i) for i in range(known.size())]:
                if function.funcName().lower() not in allowed:
                    registry.dropFunction(function)

    def view(self, dataset: GovernedDataset) -> DataFrame:
        df = dataset.read(self.session)
        if dataset.namespace is not None:
            column, value = dataset.namespace
            df = df.filter(F.col(column) == value)
        return df.drop(*dataset.masked)

    def query(self, text: str) -> DataFrame:
        """A query over the views. It runs as a subquery, so commands and writes do not parse."""
        df = self.session.sql(f"SELECT * FROM (\n{text}\n) governed")
        self.check(df)
        return df

    def check(self, df: DataFrame) -> None:
        """Refuse what resolves without being a governed view or an allowed function."""
        views = set()
        for node in _nodes(json.loads(df._jdf.queryExecution().analyzed().toJSON())):
            kind = str(node.get("class", node.get("product-class", ""))).rpartition(".")[2]
            if REFUSED.match(kind):
                raise ValueError(f"{kind} is refused; give dates and users as literals")
            if kind == "TableIdentifier":
                if node.get("database") or node["table"] not in self.datasets:
                    raise ValueError(f"{node['table']} is not a governed dataset")
                views.add(node["table"])
            if kind == "AliasIdentifier" and node.get("qualifier") not in (None, [], "[]"):
                raise ValueError(f"{node['name']} is not a governed dataset")
        if not views:
            raise ValueError("a query reads at least one governed dataset")

    def capped(self, text: str, max_rows: int = 50) -> DataFrame:
        """The first ``max_rows`` rows (at most MAX_ROWS) and whether the query has more, from one run.

        One row more than asked is fetched, so the window runs over at most MAX_ROWS + 1 rows.
        """
        if not 1 <= max_rows <= MAX_ROWS:
            raise ValueError(f"ask for 1 to {MAX_ROWS} rows")
        fetched = self.query(text).limit(max_rows + 1)
        # The rows come from one partition in the query's order, which a constant order keeps.
        every = Window.partitionBy(F.lit(0))
        marked = fetched.withColumn("truncated", F.count("*").over(every) > max_rows).withColumn("_n", F.row_number().over(every.orderBy(F.lit(0))))
        return marked.filter(F.col("_n") <= max_rows).drop("_n")

    def fetch(self, text: str, max_rows: int = 50) -> tuple[list, bool]:
        """The rows of ``capped`` without the flag, and the flag."""
        rows = self.capped(text, max_rows).collect()
        return [row[:-1] for row in rows], bool(rows) and rows[0].truncated
