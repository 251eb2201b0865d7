"""Boolean formulas over rules: written form, compiled form and evaluation for all runs at once."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Operators from the loosest to the tightest.
BINDS = {"OR": 1, "XOR": 2, "AND": 3, "NOT": 4}
COMPILED = "canonical string, postfix array<struct<op:string,name:string,n:int>>, atoms array<string>, problem string"


def _text(node: tuple) -> str:
    op, parts = node
    return parts if op == "" else f"(NOT {_text(parts[0])})" if op == "NOT" else "(" + f" {op} ".join(map(_text, parts)) + ")"


def _node(op: str, parts: list[tuple]) -> tuple:
    """An operator over its parts: those of the same operator join it, and names come first, negations last."""
    if op == "NOT":
        return op, parts
    flat = [x for p in parts for x in (p[1] if p[0] == op else [p])]
    return op, sorted(flat, key=lambda p: ({"": 0, "NOT": 2}.get(p[0], 1), _text(p)))


def _postfix(node: tuple) -> list[tuple[str, str | None, int]]:
    op, parts = node
    if op == "":
        return [("", parts, 0)]
    out = [step for p in parts for step in _postfix(p)]
    # And and or combine two at a time, in order; exclusive or looks at all of its parts.
    return out + ([(op, None, 2)] * (len(parts) - 1) if op in ("AND", "OR") else [(op, None, len(parts))])


def compile_formula(text: str | None) -> tuple:
    """(canonical text, steps of a stack machine, names, problem) of one formula (F-30); the first three are null if there is a problem."""
    words = re.findall(r"[()]|[\w.:-]+", text or "", re.ASCII)
    if not words:
        return None, None, None, "empty expression"
    if "".join(words) != re.sub(r"\s+", "", text):
        return None, None, None, "contains unsupported characters"
    done: list[tuple] = []
    waiting: list[str] = []

    def close(least: int) -> None:
        while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= least:
            op = waiting.pop()
            right = done.pop()
            done.append(_node(op, [right] if op == "NOT" else [done.pop(), right]))

    names, value = [], False  # whether a value has just ended
    for word in words:
        upper = word.upper()
        prefix = word == "(" or upper == "NOT"
        if prefix == value if prefix or upper in BINDS or word == ")" else value:
            return None, None, None, f"unexpected token {word!r}"
        if not prefix and (upper in BINDS or word == ")") and not value:
            return None, None, None, f"unexpected token {word!r}"
        if prefix:
            waiting.append("(" if word == "(" else "NOT")
        elif word == ")":
            close(0)
            if not waiting:
                return None, None, None, "unexpected token ')'"
            waiting.pop()
        elif upper in BINDS:
            close(BINDS[upper])
            waiting.append(upper)
            value = False
        else:
            names.append(word)
            done.append(("", word))
            value = True
    if not value:
        return None, None, None, "unexpected end of expression"
    close(0)
    if waiting:
        return None, None, None, "unbalanced parentheses"
    return _text(done[0]), _postfix(done[0]), names, None


def compiled(formulas: DataFrame, column: str = "expression") -> DataFrame:
    """Formulas with ``canonical, postfix, atoms, problem`` (F-30). A formula that does not parse keeps its row, with the problem; null is empty.

    Formulas are the rows of knowledge bases, so this Python step is outside the path of samples.
    """

    @F.pandas_udf(COMPILED)
    def parse(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([compile_formula(t) for t in text], columns=["canonical", "postfix", "atoms", "problem"])

    return formulas.withColumn("_c", parse(F.col(column))).select("*", "_c.*").drop("_c")


_VALUE = "struct<ok:boolean,ids:array<string>,lower:double,forced:double>"


def _value(ok: Column, ids: Column, lower: Column, forced: Column) -> Column:
    return F.struct(ok.alias("ok"), ids.alias("ids"), lower.cast("double").alias("lower"), forced.cast("double").alias("forced"))


def _joint(ids: Column, of: Column, least: float, eps: float) -> Column:
    """Members that must occur together: the Fréchet bound of their frequencies, and whether it holds. No members: true, of frequency 0."""
    none = F.array().cast("array<string>")

    def bound(q: Column) -> Column:
        upper = F.array_min(q)
        lower = F.least(F.greatest(F.lit(0.0), F.aggregate(q, F.lit(0.0), lambda a, x: a + x) - (F.size(q) - 1)), upper)
        return F.struct(lower.alias("lower"), F.coalesce(F.try_divide(lower, upper), F.lit(0.0)).alias("forced"))

    def kept(b: Column) -> Column:
        ok = (b["lower"] > eps) & (b["forced"] >= least - eps)
        return _value(ok, F.when(ok, ids).otherwise(none), b["lower"], b["forced"])

    once = F.get(F.transform(F.array(bound(F.transform(ids, lambda i: F.coalesce(F.element_at(of, i), F.lit(0.0))))), kept), F.lit(0))
    return F.when(F.size(ids) == 0, _value(F.lit(True), none, F.lit(0.0), F.lit(0.0))).otherwise(once)


def evaluate_formulas(runs: DataFrame, evidence: DataFrame, formulas: DataFrame, min_fraction: float = 2 / 3, eps: float = 1e-9) -> DataFrame:
    """Formulas that fire in each run (A-8), any nesting of AND, OR, XOR and NOT.

    ``runs``: ``run_id, project_id``; ``evidence``: ``run_id, member, lower`` with one row for each member (``best_member_evidence``);
    ``formulas``: ``project_id, formula_id, postfix, atoms`` (``compiled``). AND holds if the Fréchet bound of its members'
    frequencies does, at every step; OR takes the true side whose best member has the higher frequency, on ties that with the first names;
    XOR holds for an odd number of true parts, three or more of which must occur together; NOT turns the truth and has no frequency.
    Returns ``run_id, formula_id, members, lower, forced``. A run meets its project's formulas only, and of those without NOT just the ones that share a member. Members meet the evidence by name, so that
    a formula has the frequencies of its own members and never those of the whole run.
    """
    mine = runs.select("run_id", "project_id").distinct()
    seen = evidence.filter(F.col("lower") > eps).select("run_id", "member", F.col("lower").cast("double").alias("lower")).join(mine, "run_id")
    # No member has the empty name: by it a run meets the formulas with NOT, which can hold without any member.
    seen = seen.unionByName(mine.select("run_id", "project_id", F.lit("").alias("member"), F.lit(None).cast("double").alias("lower")))
    turns = F.exists("postfix", lambda s: s["op"] == "NOT")
    names = F.array_distinct(F.concat("atoms", F.when(turns, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))))
    parts = formulas.filter("postfix is not null").select("project_id", "formula_id", "postfix", F.explode(names).alias("member"))
    own = F.map_from_entries(F.collect_set(F.when(F.col("lower").isNotNull(), F.struct("member", "lower"))))
    x = parts.hint("merge").join(seen, ["project_id", "member"]).groupBy("run_id", "formula_id", "postfix").agg(own.alias("of"))
    of, none = F.col("of"), F.array().cast("array<string>")
    false = _value(F.lit(False), none, F.lit(0.0), F.lit(0.0))
    best = lambda v: F.coalesce(F.array_max(F.transform(v["ids"], lambda i: F.element_at(of, i))), F.lit(0.0))

    def name(s: Column) -> Column:
        q = F.coalesce(F.element_at(of, s["name"]), F.lit(0.0))
        return _value(q > eps, F.when(q > eps, F.array(s["name"])).otherwise(none), q, F.lit(1.0))

    def either(a: Column, b: Column) -> Column:
        second = (best(b) > best(a)) | ((best(b) == best(a)) & (F.array_join(F.sort_array(b["ids"]), "\0") < F.array_join(F.sort_array(a["ids"]), "\0")))
        return F.when(a["ok"] & b["ok"], F.when(second, b).otherwise(a)).when(b["ok"], b).otherwise(a)

    def odd(parts: Column) -> Column:
        true = F.filter(parts, lambda v: v["ok"])
        united = F.array_distinct(F.flatten(F.transform(true, lambda v: v["ids"])))
        return F.when(F.size(true) % 2 == 0, false).when(F.size(true) == 1, F.get(true, F.lit(0))).otherwise(_joint(united, of, min_fraction, eps))

    def step(stack: Column, s: Column) -> Column:
        last, before, n = F.try_element_at(stack, F.lit(-1)), F.get(stack, F.size(stack) - 2), F.size(stack)
        both = F.when(before["ok"] & last["ok"], _joint(F.array_union(before["ids"], last["ids"]), of, min_fraction, eps)).otherwise(false)
        put = lambda taken, v: F.concat(F.slice(stack, F.lit(1), n - taken), F.array(v))
        return (
            F.when(s["op"] == "", F.concat(stack, F.array(name(s))))
            .when(s["op"] == "NOT", put(F.lit(1), _value(~last["ok"], none, F.lit(0.0), F.lit(0.0))))
            .when(s["op"] == "AND", put(F.lit(2), both)).when(s["op"] == "OR", put(F.lit(2), either(before, last)))
            .otherwise(put(s["n"], odd(F.slice(stack, n - s["n"] + 1, s["n"]))))
        )

    x = x.withColumn("v", F.element_at(F.aggregate("postfix", F.array().cast(f"array<{_VALUE}>"), step), 1))
    return x.filter("v.ok").select("run_id", "formula_id", F.sort_array("v.ids").alias("members"), F.col("v.lower").alias("lower"), F.col("v.forced").alias("forced"))


def without_repeated_rules(fired: DataFrame, formulas: DataFrame, hits: DataFrame) -> DataFrame:
    """Fired formulas but for pure ORs that one member fires whose own rule reports the same drug in the run (A-8b).

    ``formulas``: ``formula_id, drug, postfix``; ``hits``: ``run_id, member, drug`` of visible rules.
    """
    plain = ~F.exists("postfix", lambda s: s["op"].isin("AND", "XOR", "NOT"))
    x = fired.join(formulas.select("formula_id", "drug", plain.alias("_plain")).hint("merge"), "formula_id")
    alone = F.when(F.col("_plain") & (F.size("members") == 1), F.get("members", F.lit(0)))
    told = hits.select("run_id", F.col("member").alias("_alone"), "drug").distinct()
    return x.withColumn("_alone", alone).join(told, ["run_id", "_alone", "drug"], "left_anti").drop("_alone", "_plain")
