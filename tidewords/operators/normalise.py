"""Spoken numbers, money, percentages, times, dates and phone numbers written in digits, without losing the words' times.

Only words of a locale's lexicon can take part in a rewrite, so the walk over rules is done on islands of such words,
not on whole recordings: a join with the lexicon, one window for the islands, and an Arrow function over each island.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewords.operators.patterns import before, islands

#: Fixed value: the longest pause in ms inside what is rewritten.
MAX_GAP_MS = 350
#: What a lexicon's word is.
UNIT, TEN, HUNDRED, SCALE, ORDINAL, MONTH, CURRENCY, PERCENT, HOUR, MINUTE, PLUS = "unit", "ten", "hundred", "scale", "ordinal", "month", "currency", "percent", "hour", "minute", "plus"
NUMBER = (UNIT, TEN, HUNDRED, SCALE)

# The forms of Russian number words, by value.
RU_UNITS = ["ноль нуль", "один одна одно одного одной одним", "два две двух двум двумя", "три трёх трех трём трем тремя", "четыре четырёх четырех четырём четырем четырьмя", "пять пяти пятью", "шесть шести шестью", "семь семи семью", "восемь восьми восемью восьмью", "девять девяти девятью", "десять десяти десятью", "одиннадцать одиннадцати", "двенадцать двенадцати", "тринадцать тринадцати", "четырнадцать четырнадцати", "пятнадцать пятнадцати", "шестнадцать шестнадцати", "семнадцать семнадцати", "восемнадцать восемнадцати", "девятнадцать девятнадцати"]
RU_TENS = ["двадцать двадцати", "тридцать тридцати", "сорок сорока", "пятьдесят пятидесяти", "шестьдесят шестидесяти", "семьдесят семидесяти", "восемьдесят восьмидесяти", "девяносто девяноста"]
RU_HUNDREDS = ["сто ста", "двести двухсот двумстам", "триста трёхсот трехсот", "четыреста четырёхсот четырехсот", "пятьсот пятисот", "шестьсот шестисот", "семьсот семисот", "восемьсот восьмисот", "девятьсот девятисот"]
RU_SCALES = ["тысяча тысячи тысяч тысячу тысячей", "миллион миллиона миллионов", "миллиард миллиарда миллиардов"]
RU_ORDINALS = ["первое первого", "второе второго", "третье третьего", "четвёртое четвертое четвёртого четвертого", "пятое пятого", "шестое шестого", "седьмое седьмого", "восьмое восьмого", "девятое девятого", "десятое десятого", "одиннадцатое одиннадцатого", "двенадцатое двенадцатого", "тринадцатое тринадцатого", "четырнадцатое четырнадцатого", "пятнадцатое пятнадцатого", "шестнадцатое шестнадцатого", "семнадцатое семнадцатого", "восемнадцатое восемнадцатого", "девятнадцатое девятнадцатого", "двадцатое двадцатого"]
RU_THIRTIETH = "тридцатое тридцатого"
RU_MONTHS = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"]
# How currencies are written; signs go before the amount, abbreviations after it.
RU_CURRENCIES = {"руб.": "рубль рубля рублей рублю рублями", "коп.": "копейка копейки копеек", "$": "доллар доллара долларов", "€": "евро", "₸": "тенге"}
RU_PERCENT, RU_HOUR, RU_MINUTE, RU_PLUS = "процент процента процентов процентах", "час часа часов", "минута минуты минут", "плюс"
#: The tens that may stand before an ordinal unit in a day of the month.
RU_DAY_TENS = ("двадцать", "тридцать")

#: Of an island's words: kind, value, text and mark by word. (places taken, what is written) from a place on, or None.
Rule = Callable[[list, list, list, list, list, int], "tuple[int, str] | None"]


def number_at(kinds: list, values: list, marks: list, i: int) -> tuple[int, int] | None:
    """(value, words taken) of the number that begins at i: sums inside a group, a scale multiplies the group before it.

    A unit after a unit means digits one by one, which are no number. A mark after a word ends the number.
    """
    total = group = 0
    opened, j = False, i
    while j < len(kinds) and kinds[j] in NUMBER:
        if kinds[j] == SCALE:
            total, group, opened = total + (group or 1) * values[j], 0, False
        elif kinds[j] == UNIT and opened and group % 10:
            return None
        else:
            group, opened = group + values[j], True
        j += 1
        if marks[j - 1]:
            break
    return (total + group, j - i) if j > i else None


def _follows(kinds: list, values: list, marks: list, i: int, kind: str, most: int | None = None) -> tuple[int, int] | None:
    """(value, place of the word of a kind) where that word comes right after a number from i on."""
    n = number_at(kinds, values, marks, i)
    if n is None or (most is not None and n[0] > most) or i + n[1] >= len(kinds) or kinds[i + n[1]] != kind:
        return None
    return n[0], i + n[1]


def _phone(kinds, values, signs, stems, marks, i):
    j = first = i + (kinds[i] == PLUS)
    while j < len(kinds) and kinds[j] == UNIT and values[j] <= 9:
        j += 1
    return (j - i, ("+" if first > i else "") + "".join(str(v) for v in values[first:j]) + marks[j - 1]) if j - first >= 10 else None


def _time(kinds, values, signs, stems, marks, i):
    hours = _follows(kinds, values, marks, i, HOUR, 23)
    minutes = hours and _follows(kinds, values, marks, hours[1] + 1, MINUTE, 59)
    return (minutes[1] + 1 - i, f"{hours[0]}:{minutes[0]:02d}{marks[minutes[1]]}") if minutes else None


def _date(kinds, values, signs, stems, marks, i):
    at, day = i, 0
    if signs[i] == "day" and i + 1 < len(kinds) and kinds[i + 1] == ORDINAL and values[i + 1] <= 9:
        at, day = i + 1, values[i]
    if kinds[at] != ORDINAL or at + 1 >= len(kinds) or kinds[at + 1] != MONTH:
        return None
    return at + 2 - i, f"{day + values[at]} {stems[at + 1]}{marks[at + 1]}"


def _money(kinds, values, signs, stems, marks, i):
    found = _follows(kinds, values, marks, i, CURRENCY)
    if not found:
        return None
    amount, at = found
    return at + 1 - i, (f"{amount} {signs[at]}" if signs[at].endswith(".") else f"{signs[at]}{amount}") + marks[at]


def _percent(kinds, values, signs, stems, marks, i):
    found = _follows(kinds, values, marks, i, PERCENT)
    return (found[1] + 1 - i, f"{found[0]}%{marks[found[1]]}") if found else None


def _plain(kinds, values, signs, stems, marks, i):
    n = number_at(kinds, values, marks, i)
    return (n[1], f"{n[0]}{marks[i + n[1] - 1]}") if n and (n[1] > 1 or n[0] >= 10) else None


@dataclass(frozen=True)
class Rules:
    """A locale's text rules: forms with what they are, and rules in order of precedence."""

    locale: str
    lexicon: tuple[tuple[str, str, int, str], ...]
    rules: tuple[Rule, ...] = (_phone, _time, _date, _money, _percent, _plain)

    def table(self, spark: SparkSession) -> DataFrame:
        """(form, kind, value, sign): one row a form, a few hundred in all."""
        return spark.createDataFrame(self.lexicon, "form string, kind string, value long, sign string")


def _forms(kind: str, groups: list[str], values: list[int], signs: list[str] | None = None) -> list[tuple[str, str, int, str]]:
    return [(w, kind, v, s) for group, v, s in zip(groups, values, signs or [""] * len(groups), strict=True) for w in group.split()]


RU = Rules(
    "ru",
    tuple(
        _forms(UNIT, RU_UNITS, list(range(20)))
        + [(w, k, v, "day" if w in RU_DAY_TENS else "") for w, k, v, _ in _forms(TEN, RU_TENS, list(range(20, 100, 10)))]
        + _forms(HUNDRED, RU_HUNDREDS, list(range(100, 1000, 100)))
        + _forms(SCALE, RU_SCALES, [10**3, 10**6, 10**9])
        + _forms(ORDINAL, [*RU_ORDINALS, RU_THIRTIETH], [*range(1, 21), 30])
        + _forms(MONTH, RU_MONTHS, list(range(1, 13)))
        + _forms(CURRENCY, list(RU_CURRENCIES.values()), [0] * len(RU_CURRENCIES), list(RU_CURRENCIES))
        + _forms(PERCENT, [RU_PERCENT], [0])
        + _forms(HOUR, [RU_HOUR], [0])
        + _forms(MINUTE, [RU_MINUTE], [0])
        + _forms(PLUS, [RU_PLUS], [0])
    ),
)


def walk(rules: tuple[Rule, ...], kinds: list, values: list, signs: list, stems: list, marks: list) -> list[dict]:
    """Where each output of an island begins, how many words it takes, and what is written (None: the word as it is)."""
    out, i = [], 0
    while i < len(kinds):
        found = next((m for m in (rule(kinds, values, signs, stems, marks, i) for rule in rules) if m), (1, None))
        out.append({"at": i, "n": found[0], "text": found[1]})
        i += found[0]
    return out


def rewrite(words: DataFrame, rules: Rules = RU, keys: tuple[str, ...] = ("rec_id", "channel"), max_gap_ms: int = MAX_GAP_MS) -> DataFrame:
    """Words (keys, seq, word, start_ms, end_ms, conf_milli, …) with spoken numbers written, and ``original`` and ``span``.

    Each stream of ``keys`` is read in order of seq; nothing is joined over a pause beyond ``max_gap_ms``. A written word spans its
    first input's start to its last one's end, has the least confidence of them and the first one's other columns;
    ``original`` is what was said (null where nothing changed), ``span`` how many words it took. Marks at a word's end
    are kept from the last word. Null words are no forms and stay. An island of forms is one array: it is as long as
    numbers are dictated without a pause.
    """
    had = "original" in words.columns
    rows = words if had else words.withColumn("original", F.lit(None).cast("string"))
    kept = rows.columns
    stem = F.regexp_replace("word", r"[.,!?;:]+$", "")
    forms = F.broadcast(rules.table(words.sparkSession))  # a few hundred rows, fixed
    known = rows.withColumn("__stem", stem).join(forms.toDF("__form", "__kind", "__value", "__sign"), F.lower("__stem") == F.col("__form"), "left")
    order = before(list(keys), ["seq"])
    last = lambda c: F.last(c).over(order)
    opens = F.col("__kind").isNull() | last("__kind").isNull() | (F.col("start_ms") - last("end_ms") > max_gap_ms)
    dealt = islands(known, list(keys), ["seq"], opens, "__island")
    plain = dealt.where("__kind IS NULL").select(*kept, F.lit(1).alias("span"))
    item = F.struct("seq", "__kind", "__value", "__sign", "__stem", F.expr("substring(word, length(__stem) + 1)").alias("__mark"), F.struct(*kept).alias("row"))
    grouped = dealt.where("__kind IS NOT NULL").groupBy(*keys, "__island").agg(F.array_sort(F.collect_list(item)).alias("ws"))

    @F.pandas_udf("array<struct<at: int, n: int, text: string>>")
    def walked(kinds: pd.Series, values: pd.Series, signs: pd.Series, stems: pd.Series, marks: pd.Series) -> pd.Series:
        return pd.Series([walk(rules.rules, *map(list, island)) for island in zip(kinds, values, signs, stems, marks, strict=True)])

    out = grouped.withColumn("m", F.explode(walked("ws.__kind", "ws.__value", "ws.__sign", "ws.__stem", "ws.__mark")))
    part = out.select(F.slice("ws.row", F.col("m.at") + 1, F.col("m.n")).alias("rs"), "m")
    said = F.array_join(F.transform("rs", lambda r: F.coalesce(r["original"], r["word"])), " ")
    changed = F.col("m.text").isNotNull() & (F.col("m.text") != said)
    new = {
        "word": F.coalesce("m.text", F.col("rs")[0]["word"]),
        "end_ms": F.element_at("rs", -1)["end_ms"],
        "conf_milli": F.array_min(F.transform("rs", lambda r: r["conf_milli"])),
        "original": F.when(F.col("m.text").isNull(), F.col("rs")[0]["original"]).otherwise(F.when(changed, said)),
    }
    return plain.unionByName(part.select(*(new.get(c, F.col("rs")[0][c]).alias(c) for c in kept), F.col("m.n").alias("span")))
