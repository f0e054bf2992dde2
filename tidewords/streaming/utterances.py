"""Utterances of live streams: where they are cut, what is told while they last, and controls that cut or clear them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewords.streaming.ordered import in_order

OUT = "item long, kind string, start_ms long, end_ms long, text string, delta string, cut string"
STATE = "item long, start long, loud long, told_at long, text string, told string, at long"


@dataclass(frozen=True)
class Rules:
    """When an utterance ends; all in ms. A search of 0 looks for no pauses, a limit of 0 sets none."""

    silence: int = 1200
    limit: int = 20_000
    search: int = 8_000
    pause: int = 400
    dip: int = 150
    guard: int = 700
    interval: int = 300


@dataclass
class Item:
    """The utterance that is open: its number, start, last sound, last partial, text so far and text told."""

    item: int
    start: int
    loud: int
    told_at: int
    text: str = ""
    told: str = ""


def _delta(told: str, text: str) -> str:
    return text if not told else text[len(told) :] if text.startswith(told) else ""


def hear(now: Item, rules: Rules, at: int, loud: bool, word: str, control: str) -> list[tuple]:
    """Take one stretch of audio that ends at ``at``; what is to be told of it, as rows of ``OUT``. Changes the item."""
    out: list[tuple] = []

    def opened(start: int) -> None:
        now.item, now.start, now.loud, now.text, now.told = now.item + 1, start, start, "", ""

    def finish(cut: str) -> None:
        if now.text or cut == "commit":
            out.append((now.item, "final", now.start, at, now.text, "", cut))
        opened(at)

    if control == "clear":
        out.append((now.item, "cleared", now.start, at, "", "", ""))
        opened(at)
        return out
    if loud:
        now.loud = at
        if word and not now.text:
            out.append((now.item, "speech_started", now.start, at, "", "", ""))
        now.text = f"{now.text} {word}".strip()
        if now.text != now.told and at - now.told_at >= rules.interval:
            out.append((now.item, "partial", now.start, at, now.text, _delta(now.told, now.text), ""))
            now.told, now.told_at = now.text, at
    quiet, length = at - now.loud, at - now.start
    into = length - (rules.limit - rules.search)
    if control == "commit":
        finish("commit")
    elif rules.limit and length >= rules.limit:
        finish("max_length")
    elif rules.limit and rules.search and into >= 0 and now.text and quiet >= rules.pause - min(into / rules.search, 1) * (rules.pause - rules.dip):
        finish("pause")
    elif quiet >= rules.silence:
        if now.text:
            finish("silence")
        else:  # nothing to end: the item begins nearer to the speech that is to come
            now.start = max(now.start, at - rules.guard)
    return out


def utterances(stream: DataFrame, key: str, rules: Rules, idle_ms: int = 3_600_000) -> DataFrame:
    """(key, item, kind, start_ms, end_ms, text, delta, cut) of rows (key, at_ms, event_id, loud, word, control) with a watermark on ``at``.

    Kinds are speech_started, partial (with what it adds to the last one), final (with why it was cut: silence, pause,
    max_length, commit) and cleared. A commit cuts after all that came before it and tells even an empty text; a clear
    throws away what the item holds. Silence without text moves the item's start. A stream's state goes when the
    watermark is ``idle_ms`` past its last row; what it held without a cut is not told.
    """

    def step(_, state: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        at, _event, loud, word, control = row
        now = Item(*state[:6]) if state else Item(0, at, at, at - rules.interval)
        told = hear(now, rules, at, bool(loud), word or "", control or "")
        return (now.item, now.start, now.loud, now.told_at, now.text, now.told, at), told

    return in_order(stream, key, ["loud", "word", "control"], step, STATE, OUT, lambda s: s[6] + idle_ms)


def utterance_words(words: DataFrame) -> DataFrame:
    """Words (…, item_start_ms, clock_ms, start_ms, end_ms) of finals, from the recogniser's clock to the stream's time.

    The clock runs from the last reset less the silence put in front; no word begins before its item or ends before it begins.
    """
    start = F.greatest(F.col("start_ms") + F.col("clock_ms"), F.col("item_start_ms"))
    return words.withColumns({"start_ms": start, "end_ms": F.greatest(F.col("end_ms") + F.col("clock_ms"), start)})
