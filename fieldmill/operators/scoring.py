"""Scoring model outputs against JSON ground truth: parse, match keys, compare values, roll up.

A record stays one row all the way: one Arrow UDF decodes both texts and pairs their values, and
verdicts are an array that the value cascade makes of these pairs natively.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import jsonfix
from ..functions.jsonfix import FLAG, NUMBER, TEXT, struct
from ..functions.similarity import choose_key, likeness_from, plain_key_lists, plain_string
from ..functions.text import json_candidate, let, truncated
from ..functions.values import FUZZY, cascade, legacy_value, verdict

LEAF = struct(a=TEXT, b=TEXT, an=NUMBER, bn=NUMBER, same=FLAG, likeness=NUMBER)
FIELD = struct(gt_key=TEXT, pred_key=TEXT, gt_text=TEXT, pred_text=TEXT, nested=FLAG, leaves=T.ArrayType(LEAF))
PAIRS = struct(gt_error=TEXT, error=TEXT, used_repair=FLAG, fields=T.ArrayType(FIELD))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that later expressions read and don't compute anew; a column of df may be made
    anew under its name."""
    made = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, made.alias("_once")).select(*(f"_once.{c}" if c in columns else c for c in df.columns), *(f"_once.{c}" for c in columns if c not in df.columns))


def parse_column(df: DataFrame, column: str, out: str = "parsed") -> DataFrame:
    """df with a struct of fields (position, key, kind, text), candidate, repaired, used_repair, error."""
    return df.withColumn(out, jsonfix.parse_output(F.col(column)))


# --- pairing: which values are held against each other, without judging them --------------------


def _number(value) -> float | None:
    if not isinstance(value, (bool, int, float)):
        return None
    try:
        return float(value)
    except OverflowError:
        return math.inf if value > 0 else -math.inf


def _leaf(gt, pred) -> tuple:
    """What the cascade needs to know of two values that aren't both objects or both lists."""
    same = ratio = None
    if isinstance(gt, str) and isinstance(pred, str) and gt != pred:
        a, b = plain_string(gt), plain_string(pred)
        same = a == b
        ratio = None if same or not a or not b else likeness_from(a, b, FUZZY)
    return jsonfix.text_of(gt), jsonfix.text_of(pred), _number(gt), _number(pred), same, ratio


def leaves(gt, pred) -> list[tuple] | None:
    """The pairs of plain values that must all match for two values to do so; None where their
    shapes already differ. Objects pair by matching key, lists by position."""
    if isinstance(gt, dict) and isinstance(pred, dict):
        names = list(pred)
        found = [(v, choose_key(k, names)) for k, v in gt.items()]
        parts = [_missing(v) if name is None else leaves(v, pred[name]) for v, name in found]
    elif isinstance(gt, list) and isinstance(pred, list):
        parts = [leaves(a, b) for a, b in zip(gt, pred)] if len(gt) == len(pred) else [None]
    elif any(isinstance(v, (dict, list)) for v in (gt, pred)):
        return None
    else:
        return [_leaf(gt, pred)]
    return None if None in parts else [x for p in parts for x in p]


def _missing(gt) -> list[tuple] | None:
    """A value without a partner matches if it is empty, as against null."""
    return None if isinstance(gt, (dict, list)) else [_leaf(gt, None)]


@F.arrow_udf(PAIRS)
def _paired(gt: pa.Array, candidate: pa.Array, repaired: pa.Array) -> pa.Array:
    gt_errors, errors, useds, sizes, lengths = [], [], [], [], []
    fields: list[list] = [[] for _ in range(5)]
    flat: list[list] = [[] for _ in range(6)]
    for g, c, r in zip(gt.to_pylist(), candidate.to_pylist(), repaired.to_pylist()):
        want, wrong = jsonfix.decoded(g)
        if not wrong and not isinstance(want, dict):
            wrong = f"not an object but {jsonfix.kind_of(want)}"
        have, used, error = jsonfix.object_of(c, r)
        gt_errors.append(wrong)
        errors.append(error)
        useds.append(used)
        sizes.append(None if wrong else len(want))
        names = list(have or ())
        for key, value in () if wrong else want.items():
            name = choose_key(key, names) if names else None
            other = have[name] if name is not None else None
            part = _missing(value) if name is None else leaves(value, other)
            nested = isinstance(value, (dict, list)) or isinstance(other, (dict, list))
            for column, x in zip(fields, (key, name, jsonfix.text_of(value), jsonfix.text_of(other), nested)):
                column.append(x)
            lengths.append(None if part is None else len(part))
            for leaf in part or ():
                for column, x in zip(flat, leaf):
                    column.append(x)
    kinds = (pa.string(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.float64())
    held = jsonfix.listed(list(zip(("a", "b", "an", "bn", "same", "likeness"), flat, kinds)), lengths)
    names = ("gt_key", "pred_key", "gt_text", "pred_text", "nested")
    rows = pa.StructArray.from_arrays([*(pa.array(v, type=t) for v, t in zip(fields, (*[pa.string()] * 4, pa.bool_()))), held], names=[*names, "leaves"])
    whole = pa.ListArray.from_arrays(jsonfix.ranges(sizes), rows)
    return pa.StructArray.from_arrays([pa.array(gt_errors, type=pa.string()), pa.array(errors, type=pa.string()), pa.array(useds, type=pa.bool_()), whole], names=["gt_error", "error", "used_repair", "fields"])


def _verdict(f: Column, parsed: Column) -> Column:
    """The verdict on one paired field."""

    def of(found: Column) -> Column:
        all_ = F.coalesce(F.forall(found, lambda v: v["matched"]), F.lit(False))
        one = F.get(found, F.lit(0))
        return (
            F.when(~parsed, verdict(False, "mismatch"))
            .when(f["pred_key"].isNull(), F.when(all_, verdict(True, "missing_ok")).otherwise(verdict(False, "mismatch")))
            .when(f["nested"], F.when(all_, verdict(True, "exact")).otherwise(verdict(False, "mismatch")))
            .otherwise(one)
        )

    def told(v: Column) -> Column:
        ratio = F.when(v["match_type"] == "fuzzy", F.get(f["leaves"], F.lit(0))["likeness"])
        return F.struct(f["gt_key"].alias("gt_key"), f["pred_key"].alias("pred_key"), f["gt_text"].alias("gt_text"), f["pred_text"].alias("pred_text"), v["matched"].alias("matched"), v["match_type"].alias("match_type"), ratio.alias("similarity"))

    return let(let(F.transform(f["leaves"], cascade), of), told)


def judged(df: DataFrame, gt: str = "gt", pred: str = "pred") -> DataFrame:
    """df with gt_error, error, used_repair, and verdicts: an array of struct(gt_key, pred_key,
    gt_text, pred_text, matched, match_type, similarity) for the ground truth's fields in order.

    Ground truth must be strict JSON; outputs may be repaired. Two fields may take the same predicted
    key. A ground truth that can't be parsed has null verdicts; an output that can't be has all
    fields unmatched. One scan, one pass through Python, no shuffle.
    """
    one = once(df, _c=json_candidate(F.col(pred)))
    one = once(one, _p=_paired(F.col(gt).cast("string"), F.col("_c"), jsonfix.repair(F.col("_c"))))
    made = F.transform("_p.fields", lambda f: _verdict(f, F.col("_p.error").isNull()))
    return once(one, _v=made).select(*df.columns, "_p.gt_error", "_p.error", "_p.used_repair", F.col("_v").alias("verdicts"))


def field_verdicts(df: DataFrame, keys: list[str], gt: str = "gt", pred: str = "pred") -> DataFrame:
    """A row for every ground-truth field of df (keys identify a row; gt, pred are JSON texts): keys,
    pos, gt_key, pred_key, gt_text, pred_text, matched, match_type, similarity (see judged)."""
    return judged(df.select(*keys, gt, pred), gt, pred).select(*keys, F.posexplode("verdicts").alias("pos", "v")).select(*keys, "pos", "v.*")


def compare_json(df: DataFrame, keys: list[str], columns: list[tuple[str, str]], out: str = "v") -> DataFrame:
    """df's keys and the verdict on two JSON values of any kind (gt, pred): a record of one field each."""
    gt, pred = columns[0]
    wrap = lambda c: F.concat(F.lit('{"x":'), F.col(c), F.lit("}"))
    return judged(df.select(*keys, wrap(gt).alias("gt"), wrap(pred).alias("pred"))).select(*keys, F.get("verdicts", F.lit(0)).alias(out))


def score(df: DataFrame, keys: list[str], gt: str = "gt", pred: str = "pred") -> DataFrame:
    """A row for every record: keys, correct, total, accuracy, valid_json, parse_error.

    A ground truth without fields scores 1 of 0 of 0 if the output parses; one that can't be parsed
    scores 0 of 0 and counts as a parse error, and so does an output that can't be parsed.
    """
    rows = judged(df.select(*keys, gt, pred), gt, pred)
    return rows.select(*keys, *_scores())


def _scores() -> list[Column]:
    correct = F.coalesce(F.size(F.filter("verdicts", lambda v: v["matched"])), F.lit(0))
    total = F.greatest(F.size("verdicts"), F.lit(0))
    valid = F.col("gt_error").isNull() & F.col("error").isNull()
    correct = F.greatest(correct, F.lit(0))
    return [correct.alias("correct"), total.alias("total"), F.when(~valid, 0.0).when(total == 0, 1.0).otherwise(correct / total).alias("accuracy"), valid.alias("valid_json"), (~valid).alias("parse_error")]


def eval_samples(df: DataFrame, keys: list[str], meta: list[str], gt: str = "gt", pred: str = "pred") -> DataFrame:
    """A row for every generation as the step's samples file has it: keys, meta, gt_json, raw_output,
    valid_json, accuracy_pct, correct_fields, total_fields, used_repair, error and field_matches."""
    rows = judged(df.select(*keys, *meta, gt, pred), gt, pred)
    correct, total, accuracy, valid, _ = _scores()
    return rows.select(*keys, *meta, F.col(gt).alias("gt_json"), F.col(pred).alias("raw_output"), valid, (accuracy * 100).alias("accuracy_pct"), correct.alias("correct_fields"), total.alias("total_fields"), "used_repair", F.coalesce("gt_error", "error").alias("error"), F.col("verdicts").alias("field_matches"))


def sample_generations(df: DataFrame, index: str, meta: list[str], gt: str = "gt", pred: str = "pred", rows: int = 3, length: int = 220) -> DataFrame:
    """The first rows generations by index: index, meta, generated_snippet and expected_snippet."""
    first = df.orderBy(index).limit(rows)
    return first.select(F.col(index).alias("index"), *meta, truncated(F.col(pred), length).alias("generated_snippet"), truncated(F.coalesce(F.col(gt), F.lit("")), length).alias("expected_snippet"))


def dataset_accuracy(scores: DataFrame) -> DataFrame:
    """One row, accuracy in per cent: fields matched of all fields; without any field the mean score, without rows 0."""
    total = F.sum("total")
    return scores.agg(F.coalesce(F.when(total > 0, F.sum("correct") / total * 100).otherwise(F.avg("accuracy") * 100), F.lit(0.0)).alias("accuracy_pct"))


def corpus_metrics(scores: DataFrame, step: str = "step", corpus: str = "corpus") -> DataFrame:
    """By step and corpus, and overall by step (corpus null): accuracy_pct (0 without fields), parse
    errors, valid outputs, matched and total fields, examples. One pass by grouping sets."""
    out = scores.groupingSets([[step, corpus], [step]], step, corpus).agg(
        F.sum("correct").alias("matched_fields"), F.sum("total").alias("total_fields"), F.count_if("parse_error").alias("parse_errors"), F.count_if("valid_json").alias("valid_json"), F.count(F.lit(1)).alias("examples")
    )
    return out.withColumn("accuracy_pct", F.coalesce(F.try_divide(F.col("matched_fields") * 100.0, F.col("total_fields")), F.lit(0.0)))


def throughput(count: Column, seconds: Column) -> Column:
    """count a second, 0 where no time passed."""
    return F.when(seconds > 0, count / seconds).otherwise(F.lit(0.0))


def join_generations(examples: DataFrame, generations: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Examples with their generations, and what has no partner on either side."""
    both = examples.withColumn("_e", F.lit(True)).join(generations.withColumn("_g", F.lit(True)), keys, "full_outer")
    return both.filter("_e and _g").drop("_e", "_g"), both.filter("_e is null or _g is null").drop("_e", "_g")


def legacy_score(df: DataFrame, keys: list[str], gt: str = "gt", pred: str = "pred") -> DataFrame:
    """keys, correct and total by the older rule: values under equal keys with equal normal forms,
    both texts parsed without repair; a record without fields scores 0 of 0."""
    both = once(df.select(*keys, gt, pred), _g=jsonfix.legacy_fields(F.col(gt)), _p=jsonfix.legacy_fields(F.col(pred)))

    def same(f: Column) -> Column:
        return legacy_value(F.get(F.filter("_p", lambda x: x["key"] == f["key"]), F.lit(0))["text"]) == legacy_value(f["text"])

    return both.select(*keys, F.size(F.filter("_g", same)).cast("long").alias("correct"), F.size("_g").cast("long").alias("total"))


def normalized_keys(fields: Column) -> Column:
    """A map of plain keys to texts from a record's fields; of equal plain keys the last wins."""
    plain = F.zip_with(plain_key_lists(F.transform(fields, lambda f: f["key"])), F.transform(fields, lambda f: f["text"]), lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    last = lambda p: F.filter(p, lambda x, i: ~F.exists(F.slice(p, i + 2, F.size(p)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(let(plain, last))


def value_by_key(fields: Column, target: Column) -> Column:
    """The text of the field whose key is the closest to target, null if none is close enough."""
    from ..functions.similarity import closest_key

    name = closest_key(target, F.transform(fields, lambda f: f["key"]))
    return let(F.struct(name.alias("n"), fields.alias("f")), lambda x: F.get(F.filter(x["f"], lambda f: f["key"] == x["n"]), F.lit(0))["text"])
