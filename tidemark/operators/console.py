"""Ad-hoc reading: one SELECT at a time over named views, its rows as text, so many at most, for so long at most.

What a query may do is decided by its plan. The parsed plan, before anything is looked up, may hold the operators of a query alone, call listed functions alone and name the given views
and its own common tables alone, so neither files nor Java methods nor scripts can be reached. The analysed plan must then read nothing but what lies below those views.
"""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Words that no query may hold, wherever they stand, and the most rows shown (the console's feature).
DENIED = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "REPLACE", "TRUNCATE", "ATTACH", "DETACH", "PRAGMA", "VACUUM", "REINDEX")
MOST_ROWS = 500
MOST_SECONDS = 5.0
#: Operators of a parsed query.
OPERATORS = frozenset("Project Filter Aggregate Sort GlobalLimit LocalLimit Offset UnresolvedWith SubqueryAlias UnresolvedSubqueryColumnAliases Join LateralJoin Union Distinct Except Intersect UnresolvedHaving WithWindowDefinition UnresolvedInlineTable OneRowRelation UnresolvedRelation Generate UnresolvedHint UnresolvedOrdinal".split())
FUNCTIONS = frozenset(
    "count sum avg mean min max min_by max_by first last any_value count_if stddev variance median percentile approx_count_distinct collect_list collect_set array_agg bool_and bool_or every some row_number rank dense_rank percent_rank ntile lag lead "
    "lower upper length char_length trim ltrim rtrim substr substring substring_index left right concat concat_ws replace translate split instr locate position lpad rpad reverse repeat initcap ascii like rlike regexp_like regexp_extract regexp_replace "
    "contains startswith endswith coalesce nvl ifnull nullif if isnull isnotnull isnan greatest least abs round floor ceil ceiling sqrt pow power exp ln log log10 mod sign cast int bigint double string date timestamp boolean float decimal "
    "date_trunc trunc year month day dayofmonth dayofweek hour minute second quarter weekofyear to_date to_timestamp date_format date_add date_sub datediff date_diff months_between add_months last_day unix_timestamp from_unixtime current_date current_timestamp now "
    "size array array_contains array_distinct array_join array_max array_min array_sort sort_array element_at explode posexplode slice struct named_struct map map_keys map_values get_json_object from_json to_json json_array_length sha2 md5 hash xxhash64 and or not in between".split()
)


class Answer(NamedTuple):
    columns: list[str]
    rows: list[list[str]]
    truncated: bool


def checked(sql: str) -> str:
    """The query without its last semicolon; an error if it isn't one SELECT or WITH without any denied word."""
    text = sql.strip().removesuffix(";").strip()
    if not text:
        raise ValueError("empty query")
    if ";" in text:
        raise ValueError("only a single statement is allowed")
    if not text.upper().startswith(("SELECT", "WITH")):
        raise ValueError("only SELECT and WITH queries are allowed")
    if found := re.search(rf"\b({'|'.join(DENIED)})\b", text.upper()):
        raise ValueError(f"{found.group(1)} is not allowed: the console only reads")
    return text


def _seq(seq) -> Iterator:
    return (seq.apply(i) for i in range(seq.size()))


def _nodes(plan) -> Iterator[tuple[str, object]]:
    """Name and node of every operator and expression of a plan, those of subqueries and common tables among them."""
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        name = node.getClass().getSimpleName()
        yield name, node
        waiting += _seq(node.children())
        if hasattr(node, "expressions") and "plans.logical" in node.getClass().getName() or name.startswith("Unresolved") and "analysis" in node.getClass().getName() and _is_plan(node):
            waiting += _seq(node.expressions())
        if name == "UnresolvedWith":
            waiting += [pair._2() for pair in _seq(node.cteRelations())]
        elif name in ("ScalarSubquery", "Exists", "ListQuery", "InSubquery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression") and name != "InSubquery":
            waiting.append(node.plan())
        if name == "InSubquery":
            waiting.append(node.query())


def _is_plan(node) -> bool:
    return any(c.getSimpleName() == "LogicalPlan" for c in _classes(node))


def _classes(node) -> Iterator:
    c = node.getClass()
    while c is not None:
        yield c
        c = c.getSuperclass()


def allowed(spark: SparkSession, sql: str, views: Iterable[str]) -> str:
    """The checked query, if its parsed plan keeps to OPERATORS, FUNCTIONS and the views; else an error."""
    text = checked(sql)
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    nodes = list(_nodes(plan))
    own = {pair._1().lower() for name, node in nodes if name == "UnresolvedWith" for pair in _seq(node.cteRelations())}
    known = own | {v.lower() for v in views}
    for name, node in nodes:
        if name == "UnresolvedRelation":
            parts = list(_seq(node.multipartIdentifier()))
            if len(parts) != 1 or parts[0].lower() not in known:
                raise ValueError(f"{'.'.join(parts)} is not a view of the console")
        elif name == "UnresolvedFunction":
            parts = list(_seq(node.nameParts()))
            if len(parts) != 1 or parts[0].lower() not in FUNCTIONS:
                raise ValueError(f"the function {'.'.join(parts)} is not allowed")
        elif name == "UnresolvedGenerator":
            if node.name().funcName().lower() not in FUNCTIONS:
                raise ValueError(f"the function {node.name().funcName()} is not allowed")
        elif name not in OPERATORS and _is_plan(node):
            raise ValueError(f"{name} is not allowed: the console only reads")
    return text


def _outside(plan, views: set[str]) -> str | None:
    """A source that the analysed plan reads outside the views."""
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        name = node.getClass().getSimpleName()
        if name == "View":
            if node.desc().identifier().table().lower() not in views:
                return node.desc().identifier().table()
            continue
        children = list(_seq(node.children()))
        if not children and name not in ("OneRowRelation", "LocalRelation", "CTERelationRef"):
            return name
        waiting += children + [x.plan() for e in _seq(node.expressions()) for n, x in _nodes(e) if n in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery")]
    return None


def read(spark: SparkSession, sql: str, views: Iterable[str] | None = None, most: int = MOST_ROWS, seconds: float = MOST_SECONDS) -> Answer:
    """Columns and up to ``most`` rows as texts (empty for null), and whether there are more, of a query over the views (by default the session's temporary ones).

    Spark limits the rows in the tasks. Work that takes longer than ``seconds`` is cancelled, with a TimeoutError.
    """
    names = {v.lower() for v in (views if views is not None else [t.name for t in spark.catalog.listTables() if t.isTemporary])}
    df = spark.sql(allowed(spark, sql, names))
    if found := _outside(df._jdf.queryExecution().analyzed(), names):
        raise ValueError(f"{found} is not a view of the console")
    shown = df.select([F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns]) if len(set(df.columns)) == len(df.columns) else df
    group, late = f"console-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.setJobGroup(group, "console", interruptOnCancel=True)
    timer.start()
    try:
        rows = [["" if x is None else str(x) for x in r] for r in shown.limit(most + 1).collect()]
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"the query took longer than {seconds} seconds") from None
        raise e
    finally:
        timer.cancel()
        for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            spark.sparkContext.setLocalProperty(key, None)
    return Answer(df.columns, rows[:most], len(rows) > most)


def page_of(raw: str | None, default: int, most: int | None = None) -> int:
    """A positive whole number from a request, the default for anything else, ``most`` at most."""
    n = int(raw) if raw and raw.strip().isdigit() and int(raw) > 0 else default
    return n if most is None else min(n, most)


def offset_of(raw: str | None) -> int:
    return page_of(raw, 0)


def hours_of(raw: str | None, allowed: tuple[int, ...] = (1, 3, 24)) -> int:
    """One of the allowed windows, the first for anything else."""
    n = page_of(raw, allowed[0])
    return n if n in allowed else allowed[0]


def shown_range(offset: int, shown: int, total: int, size: int) -> dict[str, int | None]:
    """Numbers of the first and last row shown (0 if none) and the offsets of the pages before and after, null without one."""
    return {"first": offset + 1 if shown else 0, "last": offset + shown, "previous": max(0, offset - size) if offset > 0 else None, "next": offset + size if offset + shown < total else None}
