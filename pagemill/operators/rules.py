"""Recipe rules: each gives a value Column with a score and a log text.

A rule function takes the mapped fields, its config and its target, all known on the driver,
and returns Columns; the rules of a recipe fold into one ``select``. ``register_rule`` adds a
rule type of the user's own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields as fields_of_class
from typing import Any

from pyspark.sql import Column, SparkSession, functions as F

from pagemill.functions import text as X
from pagemill.functions.html import first_image
from pagemill.operators import sections as S

HERO_TYPE = "struct<sectionLabel:string,tagline:string,description:string,backgroundImage:string,backgroundImageAlt:string>"


@dataclass
class Rule:
    id: str
    target: str
    rule_type: str
    config: dict[str, Any] = field(default_factory=dict)
    enabled: bool = True
    inferred_from: str = "manual"
    description: str = ""


@dataclass
class Recipe:
    rules: list[Rule] = field(default_factory=list)
    threshold: float = 0.8
    version: int = 1
    name: str = ""
    template: str = "practice"

    @property
    def uses_ai(self) -> bool:
        return any(r.rule_type == "ai_transform" and r.enabled for r in self.rules)

    def to_json(self) -> str:
        """The recipe as the recipe store keeps it."""
        return json.dumps(asdict(self), ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Recipe:
        """A recipe from ``to_json``; unknown keys are left out, missing ones take their defaults."""
        known = lambda kind, d: {k: v for k, v in d.items() if k in {f.name for f in fields_of_class(kind)}}
        given = known(cls, json.loads(text))
        return cls(**given | {"rules": [Rule(**known(Rule, r)) for r in given.get("rules", [])]})


@dataclass
class RuleResult:
    """``outcome`` is ``struct<value, score, category, reason, description>``.

    ``error`` is a message for rows on which the rule cannot run, null for others. Such a row is set apart by the pipeline.
    """

    outcome: Column
    ai_used: bool = False
    error: Column | None = None


def outcome(value: Column, score: Column | float, category: str, reason: Column | str, description: Column | str | None = None) -> Column:
    def lit(x):
        return x if isinstance(x, Column) else F.lit(x)

    return F.struct(
        value.alias("value"), lit(score).cast("double").alias("score"), F.lit(category).alias("category"),
        lit(reason).alias("reason"), lit(reason if description is None else description).alias("description"),
    )


class Fields:
    """Mapped fields by name; an absent field is NULL."""

    def __init__(self, columns: dict[str, Column]):
        self.columns = columns

    def get(self, name: str) -> Column:
        return self.columns.get(name, F.lit(None).cast("string"))

    def text(self, *names: str) -> Column:
        """First non-null of the named fields, as text."""
        found = [self.columns[n].cast("string") for n in names if n in self.columns]
        return F.coalesce(*found) if found else F.lit(None).cast("string")


RuleFunction = Callable[[Fields, dict[str, Any], str], RuleResult]
RULES: dict[str, RuleFunction] = {}


def register_rule(name: str, fn: RuleFunction | None = None):
    if fn is not None:
        RULES[name] = fn
        return fn
    return lambda f: register_rule(name, f)


def _nothing() -> Column:
    return F.lit(None).cast("string")


def _empty(reason: str) -> RuleResult:
    return RuleResult(outcome(_nothing(), 0.2, "structural", reason))


def _guard(present: Column, result: Column, reason: str) -> Column:
    """The empty outcome (0.2, structural) where the input is missing."""
    return F.when(present, result).otherwise(outcome(F.lit(None), 0.2, "structural", reason))


def _filled(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def run_rule(rule: Rule, fields: Fields) -> RuleResult:
    fn = RULES.get(rule.rule_type)
    if fn is None:
        return RuleResult(outcome(_nothing(), 0.0, "structural", f"Unknown rule type: {rule.rule_type}"))
    return fn(fields, rule.config, rule.target)


@register_rule("direct_map")
def _direct(fields: Fields, config: dict, target: str) -> RuleResult:
    source = config.get("sourceField", target)
    value = fields.get(source)
    has = X.nonblank(value.cast("string"))
    return RuleResult(outcome(
        F.when(has, value), F.when(has, 1.0).otherwise(0.3), "structural",
        F.when(has, "Direct mapping with value").otherwise("Source field empty"),
        F.when(has, f'Copied "{source}" → "{target}"').otherwise(f'Source field "{source}" was empty'),
    ))


@register_rule("static_value")
def _static(fields: Fields, config: dict, target: str) -> RuleResult:
    return RuleResult(outcome(
        F.lit(config.get("value")), 1.0, "structural", "Static value applied", f'Set static value for "{target}"'
    ))


@register_rule("html_clean")
def _html_clean(fields: Fields, config: dict, target: str) -> RuleResult:
    raw = fields.text(config.get("sourceField", target))
    out = F.regexp_replace(raw, r'(?i)\s*style="[^"]*"', "")
    if config.get("stripClasses", True):
        out = F.regexp_replace(out, r'(?i)\s*class="[^"]*"', "")
    out = F.regexp_replace(out, r'(?i)\s*data-[a-z-]*="[^"]*"', "")
    out = F.regexp_replace(out, rf"(?i)<(p|div|span|section|article)\b[^>]*>(?:{X.WS}++|&nbsp;)*+</\1>", "")
    allowed = config.get("allowedTags")
    if allowed:
        names = "|".join(list(allowed) + ["br", "hr", "img"])
        out = F.regexp_replace(out, rf"(?i)</?(?!(?:{names})\b)[a-z][a-z0-9]*\b[^>]*>", "")

    def judge(value: Column) -> Column:
        changed = value != raw
        return outcome(
            value, F.when(changed, 0.85).otherwise(1.0), "content_quality",
            F.when(changed, "HTML cleaned (styles/classes/empty tags removed)").otherwise("HTML already clean"),
            F.when(changed, "Cleaned HTML content").otherwise("HTML was already clean"),
        )

    return RuleResult(_guard(_filled(raw), X.once(X.strip_ws(out), judge), "No HTML content to clean"))


def valid_pattern(pattern: str | None) -> bool:
    """Patterns are checked before a plan exists that could fail in a task, in the dialect that will run them."""
    if not pattern:
        return False
    try:
        SparkSession.getActiveSession().range(1).select(F.regexp_count(F.lit(""), F.lit(pattern))).collect()
        return True
    except Exception as err:
        if not any(x in str(err) for x in ("INVALID_PARAMETER_VALUE.PATTERN", "REGEX_PATTERN", "PatternSyntaxException")):
            raise
        return False


@register_rule("html_extract")
def _html_extract(fields: Fields, config: dict, target: str) -> RuleResult:
    source, pattern = config.get("sourceField", "body"), config.get("pattern")
    raw = fields.text(source)
    if not pattern:
        return _empty("No content or pattern for extraction")
    if not valid_pattern(pattern):
        return _empty(f"Invalid regex pattern: {pattern}")

    def judge(found: Column) -> Column:
        n = F.size(found)
        count = F.concat(F.lit("Extracted "), n.cast("string"), F.lit(" match(es)"))
        return outcome(
            F.array_join(found, ""), F.when(n > 0, 0.8).otherwise(0.3), "extraction",
            F.when(n > 0, count).otherwise("Pattern did not match any content"),
            F.when(n > 0, F.concat(count, F.lit(f' from "{source}"'))).otherwise(f'No matches for pattern in "{source}"'),
        )

    found = F.regexp_extract_all(raw, F.lit("(?i)" + pattern), F.lit(0))
    return RuleResult(_guard(_filled(raw), X.once(found, judge), "No content or pattern for extraction"))


@register_rule("h2_split")
def _h2_split(fields: Fields, config: dict, target: str) -> RuleResult:
    raw = fields.text(config.get("sourceField", "body"), "contentSections.body", "content")

    def without_faq(body: Column) -> Column:
        return X.once(S.detect_faq(body), lambda q: F.when(F.size(q) >= 2, S.remove_faq(body, q)).otherwise(body))

    def cut(h: Column) -> Column:
        return X.once(S.split_on_h2(h), lambda by_h2: X.once(
            (F.size(by_h2) <= 1) & (F.length(h) > S.LONG_BODY_CHARS),
            lambda grouped: F.struct(
                F.when(grouped, S.split_by_paragraphs(h)).otherwise(by_h2).alias("bodies"), grouped.alias("grouped")
            ),
        ))

    def judge(made: Column) -> Column:
        n = F.size(made["bodies"])
        value = S.sections_from_bodies(made["bodies"])
        if config.get("includeImages", True):
            value = S.extract_section_images(value)
        how = F.when(made["grouped"], "paragraph grouping").otherwise("H2 boundaries")
        text = F.concat(n.cast("string"), F.lit(" section(s) via "), how)
        done = outcome(
            value, F.when(n >= 2, 0.9).otherwise(0.6), "extraction",
            F.concat(F.lit("Split into "), text), F.concat(F.lit("Split body into "), text),
        )
        return _guard(n > 0, done, "Body was empty after splitting")

    split = X.once(X.once(X.once(S.clean_body(raw), without_faq), cut), judge)
    return RuleResult(_guard(_filled(raw), split, "No body content to split"))


@register_rule("faq_extract")
def _faq_extract(fields: Fields, config: dict, target: str) -> RuleResult:
    raw = fields.text(config.get("sourceField", "body"), "content")

    def judge(items: Column) -> Column:
        n = F.size(items)
        count = F.concat(F.lit("Extracted "), n.cast("string"))
        return outcome(
            items, F.when(n >= 2, 0.85).otherwise(0.3), "extraction",
            F.when(n >= 2, F.concat(count, F.lit(" FAQ item(s)"))).otherwise("No FAQ pattern detected"),
            F.when(n >= 2, F.concat(count, F.lit(" FAQ items"))).otherwise("No FAQ patterns found in content"),
        )

    return RuleResult(_guard(_filled(raw), X.once(S.extract_faq(raw), judge), "No content for FAQ extraction"))


@register_rule("hero_extract")
def _hero_extract(fields: Fields, config: dict, target: str) -> RuleResult:
    raw = fields.text(config.get("sourceField", "body"), "content")
    strategy = config.get("imageStrategy", "first_image")
    free = ~_filled(fields.text("featured_image")) & ~_filled(fields.text("hero.backgroundImage"))
    wanted = free if strategy == "first_image" else F.lit(False)
    label = fields.text("hero.sectionLabel")
    seen = F.struct(
        F.when(wanted, first_image(raw)).otherwise("").alias("image"),
        F.regexp_extract(raw, r"""(?i)<img[^>]+alt=["']([^"']+)["']""", 1).alias("alt"),
    )

    def judge(s: Column) -> Column:
        found, null = s["image"] != "", _nothing()
        hero = F.struct(
            F.when(_filled(label), label).alias("sectionLabel"), null.alias("tagline"), null.alias("description"),
            F.when(found, s["image"]).alias("backgroundImage"), F.when(found, s["alt"]).alias("backgroundImageAlt"),
        )
        names = F.array_join(F.filter(F.array(
            F.when(found, "backgroundImage"), F.when(found & (s["alt"] != ""), "backgroundImageAlt"),
            F.when(_filled(label), "sectionLabel"),
        ), lambda n: n.isNotNull()), ", ")
        score = F.lit(0.5) + F.when(found, 0.2).otherwise(0.0) + F.when(_filled(label), 0.1).otherwise(0.0)
        return outcome(
            hero, F.least(score, F.lit(1.0)), "extraction",
            F.when(names != "", F.concat(F.lit("Hero extracted: "), names)).otherwise("No hero content extracted from body"),
            F.when(names != "", f"Extracted hero image from body ({strategy})").otherwise("Hero extract: no content extracted"),
        )

    return RuleResult(_guard(_filled(raw), X.once(seen, judge), "No content for hero extraction"))


@register_rule("slugify")
def _slugify(fields: Fields, config: dict, target: str) -> RuleResult:
    source = config.get("sourceField", "title")
    raw = fields.text(source)
    slug = F.concat(F.lit(config.get("prefix", "")), X.slugify(raw), F.lit(config.get("suffix", "")))
    done = X.once(slug, lambda s: outcome(
        s, F.when(s != "", 1.0).otherwise(0.3), "structural",
        F.when(s != "", "Slug generated from title").otherwise("Empty slug result"),
        F.concat(F.lit('Generated slug "'), s, F.lit(f'" from "{source}"')),
    ))
    return RuleResult(_guard(_filled(raw), done, f'No value in "{source}" to slugify'))


@register_rule("ai_transform")
def _ai(fields: Fields, config: dict, target: str) -> RuleResult:
    action = config.get("action")
    return RuleResult(outcome(
        _nothing(), 0.5, "ai_ambiguity", f"AI transform pending (action: {action})", f"AI transform queued (action: {action})"
    ), True)


@register_rule("concat")
def _concat(fields: Fields, config: dict, target: str) -> RuleResult:
    names = list(config.get("fields", []))
    template = config.get("template")
    if template:
        return RuleResult(outcome(
            X.fill_template(template, {n: fields.text(n) for n in names}), 0.9, "structural",
            "Template-based concatenation", f"Concatenated {len(names)} field(s) using template",
        ))
    parts = F.filter(F.array(*[fields.text(n) for n in names]), X.nonblank) if names else F.array().cast("array<string>")
    n = F.size(parts)
    count = F.concat(F.lit("Concatenated "), n.cast("string"))
    return RuleResult(outcome(
        F.array_join(parts, config.get("separator", " ")), F.when(n == len(names), 0.95).otherwise(0.6), "structural",
        F.concat(count, F.lit(f"/{len(names)} field(s)")), F.concat(count, F.lit(f" of {len(names)} field(s)")),
    ))


@register_rule("regex_replace")
def _regex_replace(fields: Fields, config: dict, target: str) -> RuleResult:
    source, pattern = config.get("sourceField", target), config.get("pattern")
    replacement, flags = config.get("replacement", ""), config.get("flags", "gi")
    raw = fields.text(source)
    if not pattern:
        return _empty("No content or pattern for regex replace")
    if not valid_pattern(pattern):
        return _empty(f"Invalid regex: {pattern}")
    inline = "".join(f"(?{f})" for f in flags if f in "ims")
    # A dollar that is no group reference, and every backslash, is literal text in the source dialect.
    literal = re.sub(r"\$(?!\d)", r"\\$", replacement.replace("\\", "\\\\"))
    if "g" in flags:
        out = F.regexp_replace(raw, inline + pattern, literal)
    else:
        # Only the first hit: the lazy head stops before it.
        shifted = re.sub(r"\$(\d)", lambda m: f"${int(m.group(1)) + 1}", literal)
        out = F.regexp_replace(raw, rf"\A([\s\S]*?){inline}(?:{pattern})", "$1" + shifted)
    label = f"/{pattern}/{flags}"
    done = X.once(out, lambda value: outcome(
        value, 0.9, "content_quality",
        F.when(value != raw, "Regex replacement applied").otherwise("Pattern did not match"),
        F.when(value != raw, f'Applied regex {label} on "{source}"').otherwise(f'Regex {label} did not match in "{source}"'),
    ))
    return RuleResult(_guard(_filled(raw), done, "No content or pattern for regex replace"))


@register_rule("ignore")
def _ignore(fields: Fields, config: dict, target: str) -> RuleResult:
    return RuleResult(outcome(
        _nothing(), 1.0, "structural", "Field explicitly ignored", f'Field "{target}" explicitly ignored'
    ))
