"""Schema validation as one relational plan: instances' fields against declared fields, all rules in one pass."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VIOLATION = ["instance", "rule", "field", "message"]
_FIELD = {"required": "boolean", "pattern": "string", "enum": "string", "repeatable": "boolean", "attrs": "map<string,string>"}

#: Rules that an element breaks by itself, against its field's declaration (d), as conditions on one joined row.
_ELEMENT = {
    "pattern": "d.pattern is not null and not text rlike d.pattern",
    "enum": r"d.enum is not null and not array_contains(split(d.enum, '\\s+'), text)",
    "empty": "lead and blank",
    "undeclared": "d is null",
}
#: Attributes that the declared regular expression doesn't find; most fields declare none, and are through with the first condition.
_ATTRIBUTE = "if(size(d.attrs) > 0, transform(filter(map_entries(d.attrs), a -> not attrs[a.key] rlike a.value), a -> struct({no} as no, 'attribute' as rule, concat(field, '@', a.key) as field)), array())"
#: Rules on all of an instance's elements of a field; arrays of fields.
_INSTANCE = {"required": "array_except(must, filled)", "repeated": "if(size(single) > size(array_distinct(single)), array_distinct(filter(single, (x, i) -> array_position(single, x) <= i)), array())"}
RULES = ("required", "pattern", "enum", "empty", "undeclared", "repeated", "attribute")
_BROKEN = "array<struct<no: int, rule: string, field: string>>"


def _filled(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """df with columns that it lacks as nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in wanted.items() if c not in df.columns})


def checked(instances: DataFrame, found: DataFrame, fields: DataFrame, rules: tuple[str, ...] = RULES) -> DataFrame:
    """instances, all columns, with ``violations``: what the rules find in each, in the rules' order, then by field.

    instances(instance, type, ...), a row an instance; found(instance, field, text, attrs), a row an element;
    fields(type, field, required, pattern, enum, repeatable, attrs); columns left out don't restrict. A field's text
    must be found by its pattern (unanchored); an attribute that stands must match the one declared. Instances of
    types without fields have only undeclared ones. Of a field that a type declares several times each declaration
    holds, and it is repeatable if all say so.

    Each element meets its field's declaration in a plain row, so its rules are generated code; only what they find,
    and the names of its fields, are gathered for an instance. Texts are never gathered.
    """
    some = _filled(found, {"text": "string", "attrs": "map<string,string>"}).select("instance", "field", F.coalesce("text", F.lit("")).alias("text"), "attrs")
    repeatable = F.coalesce("repeatable", F.lit("repeatable" not in fields.columns)).alias("repeatable")
    of_field = Window.partitionBy("type", "field")
    declared = _filled(fields, _FIELD).select("type", "field", F.coalesce("required", F.lit(False)).alias("required"), "pattern", "enum", repeatable, F.coalesce("attrs", F.create_map().cast("map<string,string>")).alias("attrs"))
    must = declared.where("required").groupBy("type").agg(F.collect_set("field").alias("must"))
    once = F.bool_and("repeatable").over(of_field)
    declared = declared.select("type", "field", F.struct("pattern", "enum", "attrs", (~once).alias("once")).alias("d"), (F.row_number().over(of_field.orderBy("pattern", "enum")) == 1).alias("lead"))

    rows = instances.select("instance", "type", F.struct(*instances.columns).alias("own")).join(some, "instance", "left").join(declared, ["type", "field"], "left")
    rows = rows.withColumns({"lead": F.coalesce("lead", F.lit(True)), "blank": F.expr(r"text rlike '^\\s*$'")})
    number = {r: i for i, r in enumerate(RULES)}
    own = [F.expr(f"if({_ELEMENT[r]}, array(struct({number[r]} as no, '{r}' as rule, field)), array())").cast(_BROKEN) for r in rules if r in _ELEMENT]
    own += [F.expr(_ATTRIBUTE.format(no=number["attribute"])).cast(_BROKEN)] * ("attribute" in rules)
    broken = F.when(F.col("field").isNotNull(), F.concat(*own)) if own else F.lit(None).cast(_BROKEN)
    out = rows.groupBy("instance").agg(
        F.any_value("own").alias("own"), F.any_value("type").alias("type"), F.flatten(F.collect_list(broken)).alias("broken"), F.collect_set(F.when(~F.col("blank"), F.col("field"))).alias("filled"), F.collect_list(F.when(F.expr("lead and d.once"), F.col("field"))).alias("single")
    )
    out = out.join(must, "type", "left").withColumn("must", F.coalesce("must", F.array().cast("array<string>")))
    whole = [F.expr(f"transform({_INSTANCE[r]}, x -> struct({number[r]} as no, '{r}' as rule, x as field))").cast(_BROKEN) for r in rules if r in _INSTANCE]
    all_ = F.array_sort(F.concat("broken", *whole))
    return out.select(*[F.col("own")[c].alias(c) for c in instances.columns], F.transform(all_, lambda v: F.struct(v["rule"].alias("rule"), v["field"].alias("field"), F.concat(v["field"], F.lit(": "), v["rule"]).alias("message"))).alias("violations"))


def violations(instances: DataFrame, found: DataFrame, fields: DataFrame, rules: tuple[str, ...] = RULES) -> DataFrame:
    """VIOLATION of everything that the rules find."""
    return checked(instances, found, fields, rules).select("instance", F.inline("violations"))


def required(instances: DataFrame, found: DataFrame, fields: DataFrame) -> DataFrame:
    """Declared required fields that an instance lacks or leaves blank."""
    return violations(instances, found, fields, ("required",))


def pattern(instances: DataFrame, found: DataFrame, fields: DataFrame) -> DataFrame:
    """Texts that their field's pattern does not find (unanchored)."""
    return violations(instances, found, fields, ("pattern",))


def enum(instances: DataFrame, found: DataFrame, fields: DataFrame) -> DataFrame:
    """Texts outside their field's list."""
    return violations(instances, found, fields, ("enum",))


def empty(found: DataFrame) -> DataFrame:
    """Blank elements, required or not; needs no types, so each element is judged by itself."""
    blank = found.where(F.coalesce("text", F.lit("")).rlike(r"^\s*$"))
    return blank.select("instance", F.lit("empty").alias("rule"), "field", F.concat_ws(": ", "field", F.lit("empty")).alias("message"))


def undeclared(instances: DataFrame, found: DataFrame, fields: DataFrame) -> DataFrame:
    """Fields that the instance's type does not declare."""
    return violations(instances, found, fields, ("undeclared",))


def repeated(instances: DataFrame, found: DataFrame, fields: DataFrame) -> DataFrame:
    """Fields that stand several times though not declared repeatable."""
    return violations(instances, found, fields, ("repeated",))


def attribute(instances: DataFrame, found: DataFrame, fields: DataFrame) -> DataFrame:
    """Attributes of fields that the declared regular expression does not find."""
    return violations(instances, found, fields, ("attribute",))


validate = violations


def report(rows: DataFrame, ok: Column | None = None) -> DataFrame:
    """checked, fail: the rows of ``checked`` (or others, with ok saying whether a row passes), and those that fail."""
    fine = F.size("violations") == 0 if ok is None else ok
    return rows.agg(F.count("*").alias("checked"), F.count_if(~fine).alias("fail"))


_FAILURE = "array<struct<path: string, node_id: int, errors: array<string>>>"


def summary(verdicts: DataFrame, k: int) -> DataFrame:
    """One row checked, fail, failures of verdicts(path, node_id, ok, errors): the counts, and the first k failures by path, place and errors.

    Each task sends its counts and its own first k, and those are put together, so nothing unbounded meets anywhere.
    """

    def first(rows: pa.Table) -> pa.Table:
        order = pc.sort_indices(rows, sort_keys=[("path", "ascending"), ("node_id", "ascending")])
        return rows.take(order[:k])

    def partial(batches):
        checked, fail, held = 0, 0, None
        for batch in batches:
            ok = batch.column("ok")
            bad = pa.Table.from_batches([batch.filter(pc.invert(pc.fill_null(ok, False)))]).select(["path", "node_id", "errors"])
            checked, fail = checked + batch.num_rows, fail + bad.num_rows
            held = first(bad if held is None else pa.concat_tables([held, bad]))
        rows = held.to_pylist() if held is not None else []
        kind = pa.list_(pa.struct([("path", pa.string()), ("node_id", pa.int32()), ("errors", pa.list_(pa.string()))]))
        yield pa.RecordBatch.from_arrays([pa.array([checked], pa.int64()), pa.array([fail], pa.int64()), pa.array([rows], kind)], names=["checked", "fail", "failures"])

    parts = verdicts.select("path", "node_id", "ok", "errors").mapInArrow(partial, f"checked long, fail long, failures {_FAILURE}")
    held = F.slice(F.array_sort(F.flatten(F.collect_list("failures"))), 1, k)
    return parts.agg(F.coalesce(F.sum("checked"), F.lit(0)).alias("checked"), F.coalesce(F.sum("fail"), F.lit(0)).alias("fail"), held.alias("failures"))


def verdicts(rows: DataFrame, custom: DataFrame) -> DataFrame:
    """instance, ok, errors: the messages of ``checked`` rows, sorted, then those of custom checks (instance, message)."""
    more = custom.groupBy("instance").agg(F.array_sort(F.collect_list("message")).alias("more"))
    joined = rows.join(more, "instance", "left")
    errors = F.concat(F.array_sort(F.col("violations")["message"]), F.coalesce("more", F.array().cast("array<string>")))
    return joined.select("instance", (F.size(errors) == 0).alias("ok"), errors.alias("errors"))


def reconciled(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """keys, state: expected, unexpected or missing; only the first is a success."""
    f, e = found.select(*keys).distinct().withColumn("f", F.lit(True)), expected.select(*keys).distinct().withColumn("e", F.lit(True))
    state = F.when(F.col("f") & F.col("e"), "expected").when(F.col("f"), "unexpected").otherwise("missing")
    return f.join(e, keys, "full_outer").select(*keys, state.alias("state"))
