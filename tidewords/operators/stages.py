"""Text stages over word streams: what they owe, how they are chained, and which recordings can have them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewords.operators.normalise import RU, Rules, rewrite
from tidewords.operators.patterns import asof_last, before, up_to
from tidewords.sources.shared import written

STREAM = ["rec_id", "channel"]
#: Fixed value: about how many words a task of a chain takes.
TASK_WORDS = 100_000


@dataclass(frozen=True)
class Stage:
    """A named step: words (rec_id, channel, seq, word, start_ms, end_ms, …) to words with ``span``.

    ``span`` says how many words in a row, in order of seq, each output word took; null throughout a stream means one
    each. Outputs keep the order of their inputs.
    """

    name: str
    apply: Callable[[DataFrame], DataFrame]


_RULES: dict[str, Rules] = {}


def register_rules(rules: Rules) -> None:
    """Make text rules known under their locale; a locale may be a bare language."""
    _RULES[rules.locale.lower()] = rules


def locales() -> list[str]:
    return sorted(_RULES)


def rules_for(locale: str) -> Rules:
    """The rules of a locale, or of its language; a LookupError says what there is."""
    key = (locale or "").strip().lower()
    found = _RULES.get(key) or _RULES.get(key.split("-")[0])
    if not found:
        raise LookupError(_no_rules(key))
    return found


def _no_rules(key: str) -> str:
    return f"no rules for locale {key}; there are {', '.join(locales()) or 'none'}"


register_rules(RU)


def number_stage(locale: str) -> Stage:
    """Spoken numbers of a locale, written."""
    rules = rules_for(locale)
    return Stage("itn", lambda words: rewrite(words, rules))


def route(requests: DataFrame, can_punctuate: bool, default_locale: str = "ru") -> tuple[DataFrame, DataFrame]:
    """(rec_id, stage, locale) of the stages that requests get, and (rec_id, code, message) of those they can't have.

    Requests have rec_id, language, punctuate, itn and builtin (their model punctuates). The rules are those of the
    request's language, of the default where it names none.
    """
    asked = F.col("punctuate") & ~F.col("builtin")
    key = F.lower(F.trim(F.coalesce(F.nullif("language", F.lit("")), F.lit(default_locale))))
    listed = F.array(*(F.lit(x) for x in locales()))
    base = F.element_at(F.split(key, "-"), 1)
    locale = F.when(F.array_contains(listed, key), key).when(F.array_contains(listed, base), base)
    r = requests.withColumns({"key": key, "locale": locale})
    none = F.lit(None).cast("string")
    given = [("punctuation", asked & F.lit(can_punctuate), none), ("itn", F.col("itn") & F.col("locale").isNotNull(), F.col("locale"))]
    refused = [
        ("punctuation_unavailable", asked & ~F.lit(can_punctuate), F.lit("the model doesn't punctuate and no other does")),
        ("itn_unavailable", F.col("itn") & F.col("locale").isNull(), F.concat(F.lit("no rules for locale "), "key", F.lit(f"; there are {', '.join(locales()) or 'none'}"))),
    ]

    def rows(listed: list[tuple[str, Column, Column]], names: tuple[str, str]) -> DataFrame:
        made = F.array_compact(F.array(*(F.when(cond, F.struct(F.lit(k).alias(names[0]), v.alias(names[1]))) for k, cond, v in listed)))
        return r.select("rec_id", F.inline(made))

    return rows(given, ("stage", "locale")), rows(refused, ("code", "message"))


def _faults(given: DataFrame, got: DataFrame) -> DataFrame:
    """(rec_id, channel, reason) of streams whose outputs don't cover their inputs one after another."""
    n = given.groupBy(*STREAM).agg(F.count("*").alias("inputs"))
    some = F.count("span")
    m = got.groupBy(*STREAM).agg(F.count("*").alias("outputs"), some.alias("spans"), F.min("span").alias("least"), F.sum("span").alias("covered"))
    both = n.join(m, STREAM, "full").na.fill(0, ["inputs", "outputs", "spans"])
    reason = (
        F.when((F.col("spans") == 0) & (F.col("inputs") != F.col("outputs")), F.format_string("%d words for %d inputs without spans", "outputs", "inputs"))
        .when((F.col("spans") > 0) & (F.col("spans") != F.col("outputs")), F.format_string("%d words and %d spans", "outputs", "spans"))
        .when(F.col("least") < 1, F.format_string("a word covers %d inputs", "least"))
        .when((F.col("spans") > 0) & (F.col("covered") != F.col("inputs")), F.format_string("spans cover %d of %d inputs", "covered", "inputs"))
    )
    return both.select(*STREAM, reason.alias("reason")).where("reason IS NOT NULL")


def run_chain(words: DataFrame, stages: list[Stage]) -> tuple[DataFrame, DataFrame]:
    """Words after the stages, with ``span`` (how many of the first words each covers), and (rec_id, channel, stage, reason).

    Each stage sees whole streams, a channel of a recording each, over the borders of segments. Where a stage's spans
    don't add up, a stream keeps the words it had and goes on with the next stage. Spans are composed by running sums: what an
    output covers ends where its last input's cover ends, which an as-of join finds; the first stage's spans are of the first words already.
    Stages' outputs are kept as files and dealt by recording.
    """
    now, refused, tasks = words.withColumn("span", F.lit(1).cast("long")), None, 1
    for k, stage in enumerate(stages):
        got = written(stage.apply(now.drop("span")).withColumn("span", F.col("span").cast("long")))
        faults = written(_faults(now, got).withColumn("stage", F.lit(stage.name)))
        refused = faults if refused is None else refused.unionByName(faults)
        tasks = max(tasks, 1 + got.count() // TASK_WORDS)
        sound = got.join(faults, STREAM, "left_anti")
        if k == 0:
            composed = sound.withColumn("span", F.coalesce("span", F.lit(1).cast("long")))
        else:
            number = F.row_number().over(Window.partitionBy(*STREAM).orderBy("seq")).cast("long")
            covered = now.select(*STREAM, number.alias("__end"), F.sum("span").over(up_to(STREAM, ["seq"])).alias("__covered"))
            ends = sound.repartition(tasks, "rec_id").withColumn("__end", F.sum(F.coalesce("span", F.lit(1))).over(up_to(STREAM, ["seq"])))
            composed = asof_last(covered, ends, STREAM, "__end", "__end", ["__covered"], "__end")
            composed = composed.withColumn("span", F.col("__covered") - F.coalesce(F.max("__covered").over(before(STREAM, ["seq"])), F.lit(0)))
        both = composed.select(*got.columns).unionByName(now.join(faults, STREAM, "left_semi"), allowMissingColumns=True)
        now = both if k == len(stages) - 1 else (written(both) if k else both).repartition(tasks, "rec_id")
    empty = words.select(*STREAM).limit(0).withColumns({"reason": F.lit(""), "stage": F.lit("")})
    return now, (empty if refused is None else refused).select(*STREAM, "stage", "reason")


def apply_chain(words: DataFrame, stages: list[Stage]) -> DataFrame:
    """Words after the stages with spans, numbered (id) by start and channel over all channels of a recording."""
    out, _ = run_chain(words, stages)
    return out.withColumn("id", F.row_number().over(Window.partitionBy("rec_id").orderBy("start_ms", "channel", "seq")) - 1)
