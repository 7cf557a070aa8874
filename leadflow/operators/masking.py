"""Apply the masking policy carried by the schema metadata.

The policy sits in ``StructField.metadata``.  Spark keeps it on bare columns through
projections, filters, joins, group keys and written tables (an aliased column is still masked,
as what it came from), but drops it on anything computed.  So a result column without a policy
of its own is traced through the analysed plan, from the column's expression to the source
columns it reads.  A result that reads columns of one treatment gets that treatment; of several,
it is redacted.  Rules of the trace:

* Unknown is closed: a column of a file, RDD or local table without a policy is redacted.
  ``declare`` states policies for such a table; ``keep_policies`` writes the traced ones into the
  metadata, so they outlast a table that is written and read again.
* Counts (also of a predicate) and null tests reveal no value and end the trace.  Inside an
  aggregate a condition only chooses rows; the values it aggregates are traced.
* A date of low level cut to its week, month, quarter or year is open.
* A computed column keeps its type: text is treated by the policy, any other type becomes NULL.
* A pivot by a protected column would put its values into column names, so it raises.

The trace reads the plan of a session in this process's JVM; a remote session has none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.masking import fake_kind, masked

#: Expressions whose value tells nothing of the values below them.
_CLOSED = frozenset({"Count", "CountIf", "HyperLogLogPlusPlus", "IsNull", "IsNotNull", "RowNumber", "Rank", "DenseRank",
                     "PercentRank", "CumeDist", "NTile", "Grouping", "GroupingID"})
#: Leaves that hold no data of anyone.
_EMPTY_LEAVES = frozenset({"Range", "OneRowRelation"})
_COARSE = frozenset({"week", "mon", "month", "mm", "quarter", "year", "yyyy", "yy"})


@dataclass(frozen=True)
class Policy:
    """How a column is protected and the source column that says which stand-ins fit it."""
    pii_level: str = "none"
    strategy: str = "none"
    source: str = ""
    computed: bool = False       # traced, not the column's own

    @property
    def open(self) -> bool:
        return self.strategy == "none" or self.pii_level == "none"


UNKNOWN = Policy("unknown", "redact")


def _items(seq):
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _own(attr) -> Policy | None:
    meta = attr.metadata()
    if not meta.contains("pii_level"):
        return None
    source = meta.getString("source_column") if meta.contains("source_column") else attr.name()
    return Policy(meta.getString("pii_level"), meta.getString("masking_strategy"), source)


class _Trace:
    """Policies of every column of an analysed plan, by expression id."""

    def __init__(self):
        self.known: dict[int, frozenset[Policy]] = {}

    def expression(self, e) -> frozenset[Policy]:
        kind = _kind(e)
        if kind in _CLOSED:
            return frozenset()
        if kind in ("AttributeReference", "Alias"):
            own = _own(e)
            if own is not None:
                return frozenset((own,))
        if kind == "AttributeReference":
            return self.known.get(e.exprId().id(), frozenset())
        if kind == "WindowExpression":           # its frame decides which rows, not which values
            return self.expression(e.windowFunction())
        if kind == "AggregateExpression":        # its filter chooses rows
            return self.aggregated(e.aggregateFunction())
        if kind in ("TruncDate", "TruncTimestamp") and self._coarse(e):
            return frozenset(p for c in _items(e.children()) for p in self.expression(c) if p.pii_level != "low")
        if kind == "PivotFirst" and any(not p.open for p in self.expression(e.pivotColumn())):
            raise ValueError("a pivot by a protected column puts its values into column names")
        found = frozenset()
        if "Subquery" in kind or kind in ("Exists", "InSubquery"):
            found = self.outputs(e.plan()) if hasattr(e, "plan") else found
        return found.union(*[self.expression(c) for c in _items(e.children())])

    def aggregated(self, e) -> frozenset[Policy]:
        """What an aggregate function reveals: the values it takes, not the conditions that choose them."""
        kind, children = _kind(e), _items(e.children())
        if kind in _CLOSED or kind == "PivotFirst":
            return self.expression(e)
        if kind == "If":
            children = children[1:]
        elif kind == "CaseWhen":                 # condition, value, ..., and the last value if there is one
            children = children[1::2] + (children[-1:] if len(children) % 2 else [])
        elif not children or kind in ("AttributeReference", "Alias", "TruncDate", "TruncTimestamp") or "Subquery" in kind:
            return self.expression(e)
        return frozenset().union(*[self.aggregated(c) for c in children])

    def _coarse(self, e) -> bool:
        """Whether a truncation is to a week or more, by a literal format."""
        formats = [c for c in _items(e.children()) if _kind(c) == "Literal"]
        return len(formats) == 1 and str(formats[0].value()).lower() in _COARSE

    def check_pivot(self, e) -> None:
        """Raise if a column is named after a value that its expression compares a protected column with."""
        todo, name = [e], e.name()
        while todo:
            node = todo.pop()
            if _kind(node) in ("EqualTo", "EqualNullSafe"):
                sides = _items(node.children())
                bare = [c.child() if _kind(c) == "Cast" else c for c in sides]
                if any(_kind(c) == "Literal" and str(c.value()) == name for c in bare) and any(not p.open for c in sides for p in self.expression(c)):
                    raise ValueError("a pivot by a protected column puts its values into column names")
            todo += _items(node.children())

    def outputs(self, plan) -> frozenset[Policy]:
        self.plan(plan)
        return frozenset().union(*[self.expression(a) for a in _items(plan.output())])

    def plan(self, node) -> None:
        children = _items(node.children())
        kind = _kind(node)
        if kind in ("WithCTE", "CTERelationRef") or not children:
            for a in _items(node.output()):
                own = _own(a)
                self.known[a.exprId().id()] = frozenset((own,) if own else () if kind in _EMPTY_LEAVES else (UNKNOWN,))
        for c in children:
            self.plan(c)
        if kind == "Union":
            rows = [[self.expression(a) for a in _items(c.output())] for c in children]
            for a, parts in zip(_items(node.output()), zip(*rows)):
                self.known[a.exprId().id()] = frozenset().union(*parts)
            return
        if not children:
            return
        if kind == "Expand":          # unpivot and rollups: column by column
            rows = [[self.expression(e) for e in _items(p)] for p in _items(node.projections())]
            for a, parts in zip(_items(node.output()), zip(*rows)):
                self.known[a.exprId().id()] = frozenset().union(*parts)
            return
        below = {a.exprId().id() for c in children for a in _items(c.output())}
        defined = {e.exprId().id(): e for e in _items(node.expressions()) if _kind(e) == "Alias"}
        if kind == "Aggregate":
            for e in defined.values():
                self.check_pivot(e)
        rest = None
        for a in _items(node.output()):
            i = a.exprId().id()
            if i in below:
                continue
            if i in defined:
                self.known[i] = self.expression(defined[i])
                continue
            if rest is None:          # made by the node as a whole (generator, grouped function, ...)
                read = [self.expression(e) for e in _items(node.expressions())]
                rest = frozenset().union(*read) if read and kind in ("Generate", "Window", "Aggregate") else (
                    frozenset().union(*[self.expression(x) for c in children for x in _items(c.output())]))
            self.known[i] = rest


def column_policies(df: DataFrame) -> list[Policy]:
    """The policy of each column of ``df``, in order."""
    out, trace, plan = [], None, None
    for field in df.schema.fields:
        meta = field.metadata or {}
        if "pii_level" in meta:
            out.append(Policy(meta["pii_level"], meta["masking_strategy"], meta.get("source_column", field.name),
                              bool(meta.get("computed"))))
            continue
        if trace is None:
            trace, plan = _Trace(), df._jdf.queryExecution().analyzed()
            trace.plan(plan)
        found = {p for p in trace.expression(plan.output().apply(len(out))) if not p.open}
        kinds = {p.strategy for p in found}
        level = next((x for x in ("high", "unknown") if any(p.pii_level == x for p in found)), "low")
        if not found:
            out.append(Policy(source=field.name, computed=True))
        elif len(kinds) == 1:
            source = min((fake_kind(p.source) == "word", p.source) for p in found)[1]      # a telling family first
            out.append(Policy(level, next(iter(kinds)), source, True))
        else:
            out.append(Policy(level, "redact", field.name, True))
    return out


def _metadata(p: Policy) -> dict:
    return {"pii_level": p.pii_level, "masking_strategy": p.strategy, "source_column": p.source,
            **({"computed": True} if p.computed else {})}


def keep_policies(df: DataFrame) -> DataFrame:
    """``df`` with every column's policy, own or traced, in its metadata: use before a write."""
    return df.select(*[F.col(f"`{f.name}`").alias(f.name, metadata={**(f.metadata or {}), **_metadata(p)})
                       for f, p in zip(df.schema.fields, column_policies(df))])


def declare(df: DataFrame, **policies: tuple[str, str]) -> DataFrame:
    """``df`` with stated policies, column = (pii_level, strategy); all other columns are declared open."""
    unknown = sorted(set(policies) - set(df.columns))
    if unknown:
        raise ValueError(f"unknown columns {unknown}")
    return df.select(*[F.col(f"`{c}`").alias(c, metadata=_metadata(Policy(*policies.get(c, ("none", "none")), c)))
                       for c in df.columns])


def open_column(column: Column, name: str) -> Column:
    """``column`` as ``name``, declared open: for results that tell no value of what they read."""
    return column.alias(name, metadata=_metadata(Policy(source=name)))


def mask(df: DataFrame) -> DataFrame:
    """Every column masked by its own or its traced policy; a single projection."""
    return df.select(*[_masked(f, p) for f, p in zip(df.schema.fields, column_policies(df))])


def _masked(field: T.StructField, p: Policy) -> Column:
    if p.computed and not p.open and not isinstance(field.dataType, T.StringType):
        return F.lit(None).cast(field.dataType).alias(field.name)
    return masked(f"`{field.name}`", field.dataType, p.pii_level, p.strategy, p.source).alias(field.name)
