"""User-defined rules: validation, and matching of all rules in one pass over the definitions.

Most patterns can only match where a certain text stands. Three characters of the longest such text are a rule's key: definitions meet
the rules of the triples in their names by a join, and only such pairs are matched, so the cost hardly grows with the rules. The few
patterns without such a text are conditions of the scan.
"""

from __future__ import annotations

import re._constants as regex
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import check_regex, unicode_regex
from lattica.operators.name_index import GRAM, grams_of
from lattica.schema import KINDS


@dataclass(frozen=True)
class Rule:
    name: str
    description: str
    name_regex: str
    symbol_kind: str | None = None
    file_pattern: str | None = None
    has_attribute: str | None = None
    severity: str = "Warning"
    action: str = "Report"


def validate(rule: Rule) -> None:
    """Raises ValueError unless the rule can be applied."""
    if not rule.name:
        raise ValueError("a rule needs a name")
    if not rule.name_regex:
        raise ValueError(f"{rule.name}: name_regex is empty")
    check_regex(rule.name_regex, f"{rule.name}: name_regex")
    if rule.symbol_kind is not None and rule.symbol_kind not in KINDS:
        raise ValueError(f"{rule.name}: unknown symbol kind {rule.symbol_kind!r}")
    if rule.file_pattern is not None:
        check_regex(rule.file_pattern, f"{rule.name}: file_pattern")


def validated(rules: DataFrame) -> DataFrame:
    """rules(name, name_regex, symbol_kind, file_pattern, ..) with `valid` and, for those that aren't, `problem`."""
    own = [c for c in rules.columns if c not in ("valid", "problem")]

    def check(batches):
        for batch in batches:
            problems = []
            for r in batch[["name", "name_regex", "symbol_kind", "file_pattern"]].astype(object).where(batch.notna(), None).itertuples(index=False):
                try:
                    validate(Rule(r.name, "", r.name_regex, r.symbol_kind, r.file_pattern))
                    problems.append(None)
                except ValueError as e:
                    problems.append(str(e))
            yield batch[own].assign(valid=[p is None for p in problems], problem=problems)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rules.select(own).schema.fields)
    return rules.mapInPandas(check, f"{fields}, valid boolean, problem string")


def required_text(pattern: str) -> str:
    """The longest text that stands in every match of a pattern, as far as plain characters in a row tell; empty if none does."""
    parsed = parser.parse(pattern)
    if parsed.state.flags & regex.SRE_FLAG_IGNORECASE:
        return ""
    runs = [""]

    def read(items) -> None:
        for op, value in items:
            if op is regex.LITERAL:
                runs[-1] += chr(value)
            elif op is regex.SUBPATTERN and not value[1] and not value[2]:
                read(value[3])
            elif op is regex.MAX_REPEAT and value[0] >= 1:
                runs.append("")
                read(value[2])
                runs.append("")
            else:
                runs.append("")

    read(parsed)
    return max(runs, key=len)


def _conditions(found: DataFrame, rules: list[tuple[int, Rule]]) -> DataFrame:
    """Every rule as a condition of one scan."""
    hits = []
    for i, rule in rules:
        pattern = unicode_regex(rule.name_regex)
        ok = F.col("name").rlike(pattern) | F.col("qualified_name").rlike(pattern)
        if rule.symbol_kind is not None:
            ok = ok & (F.col("kind") == rule.symbol_kind)
        if rule.file_pattern is not None:
            ok = ok & F.col("file_path").rlike(unicode_regex(rule.file_pattern))
        if rule.has_attribute is not None:
            ok = ok & F.coalesce(F.col("attributes").contains(rule.has_attribute), F.lit(False))
        hits.append(F.when(ok, F.struct(F.lit(rule.name).alias("rule_name"), F.lit(rule.description).alias("message"), F.lit(i).alias("rule_ord"))))
    each = found.withColumn("_hit", F.explode(F.array_compact(F.array(*hits))))
    return each.select("_hit.rule_name", F.col("name").alias("symbol_name"), "file_path", "line", "_hit.message", "_hit.rule_ord")


def _by_text(found: DataFrame, rules: list[tuple[int, Rule, str]]) -> DataFrame:
    """Rules with a text of their own, by a triple of it."""
    rows = [(t[(len(t) - GRAM) // 2 :][:GRAM], t, i, r.name, r.description, unicode_regex(r.name_regex), r.symbol_kind, r.file_pattern and unicode_regex(r.file_pattern), r.has_attribute) for i, r, t in rules]
    table = found.sparkSession.createDataFrame(rows, "_gram string, _text string, rule_ord int, rule_name string, message string, _pattern string, _kind string, _file string, _attribute string")
    grams = F.array_union(grams_of(F.col("name")), F.coalesce(grams_of(F.col("qualified_name")), F.array().cast("array<string>")))
    near = found.withColumn("_gram", F.explode(grams)).join(table, "_gram")
    hit = lambda c: F.coalesce(F.col(c).contains(F.col("_text")) & F.rlike(F.col(c), F.col("_pattern")), F.lit(False))
    where = (F.col("_kind").isNull() | (F.col("kind") == F.col("_kind"))) & (F.col("_attribute").isNull() | F.coalesce(F.col("attributes").contains(F.col("_attribute")), F.lit(False)))
    met = near.where(where).where(hit("name") | hit("qualified_name")).where(F.col("_file").isNull() | F.rlike(F.col("file_path"), F.col("_file")))
    return met.select("rule_name", F.col("name").alias("symbol_name"), "file_path", "line", "message", "rule_ord")


def apply_rules(symbols: DataFrame, rules: list[Rule]) -> DataFrame:
    """rule_name, symbol_name, file_path, line, message, rule_ord of every match."""
    for rule in rules:
        validate(rule)
    found = symbols.where("is_definition")
    texts = [(i, rule, required_text(rule.name_regex)) for i, rule in enumerate(rules)]
    keyed, plain = [x for x in texts if len(x[2]) >= GRAM], [x[:2] for x in texts if len(x[2]) < GRAM]
    if not rules:
        return symbols.select(F.lit("").alias("rule_name"), F.col("name").alias("symbol_name"), "file_path", "line", F.lit("").alias("message"), F.lit(0).alias("rule_ord")).limit(0)
    if not keyed:
        return _conditions(found, plain)
    out = _by_text(found, keyed)
    return out.unionByName(_conditions(found, plain)) if plain else out
