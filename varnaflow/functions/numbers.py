"""Hindi number words to digits; idioms stay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WORD_CHAR, WS, boundary, interleaved

#: The number words 0 to 99, spelling variants included. Nukta letters are two code points.
UNIT_VALUES = {
    "शून्य": 0, "एक": 1, "दो": 2, "तीन": 3, "चार": 4, "पाँच": 5, "पांच": 5, "छह": 6, "छः": 6, "सात": 7, "आठ": 8, "नौ": 9,
    "दस": 10, "ग्यारह": 11, "बारह": 12, "तेरह": 13, "चौदह": 14, "पंद्रह": 15, "सोलह": 16, "सत्रह": 17, "अठारह": 18,
    "उन्नीस": 19, "बीस": 20, "इक्कीस": 21, "बाईस": 22, "तेईस": 23, "चौबीस": 24, "पच्चीस": 25, "छब्बीस": 26, "सत्ताईस": 27,
    "अट्ठाईस": 28, "उनतीस": 29, "तीस": 30, "इकतीस": 31, "बत्तीस": 32, "तैंतीस": 33, "चौंतीस": 34, "पैंतीस": 35, "छत्तीस": 36,
    "सैंतीस": 37, "अड़तीस": 38, "उनचालीस": 39, "चालीस": 40, "इकतालीस": 41, "बयालीस": 42, "तैंतालीस": 43, "चवालीस": 44,
    "पैंतालीस": 45, "छियालीस": 46, "सैंतालीस": 47, "अड़तालीस": 48, "उनचास": 49, "पचास": 50, "इक्यावन": 51, "बावन": 52,
    "तिरपन": 53, "चौवन": 54, "पचपन": 55, "छप्पन": 56, "सत्तावन": 57, "अट्ठावन": 58, "उनसठ": 59, "साठ": 60, "इकसठ": 61,
    "बासठ": 62, "तिरसठ": 63, "चौंसठ": 64, "पैंसठ": 65, "छियासठ": 66, "सड़सठ": 67, "अड़सठ": 68, "उनहत्तर": 69, "सत्तर": 70,
    "इकहत्तर": 71, "बहत्तर": 72, "तिहत्तर": 73, "चौहत्तर": 74, "पचहत्तर": 75, "छिहत्तर": 76, "सतहत्तर": 77, "अठहत्तर": 78,
    "उनासी": 79, "अस्सी": 80, "इक्यासी": 81, "बयासी": 82, "तिरासी": 83, "चौरासी": 84, "पचासी": 85, "छियासी": 86, "सत्तासी": 87,
    "अट्ठासी": 88, "नवासी": 89, "नब्बे": 90, "इक्यानवे": 91, "बानवे": 92, "तिरानवे": 93, "चौरानवे": 94, "पचानवे": 95,
    "छियानवे": 96, "सत्तानवे": 97, "अट्ठानवे": 98, "निन्यानवे": 99,
}
#: The multipliers.
MULTIPLIER_VALUES = {
    "सौ": 100, "हज़ार": 1000, "हजार": 1000, "लाख": 100000, "करोड़": 10000000,
}
#: Idioms that keep their words.
IDIOMS = (r"दो[‐\-]चार\s+बात", r"दो[‐\-]चार", r"एक[‐\-]दो", r"तीन[‐\-]चार", r"चार[‐\-]पाँच", r"आठ[‐\-]दस", r"दस[‐\-]बीस", "एक न एक", "एक ही")


#: Characters before and behind a span in which an idiom keeps its words. A span has two characters at least, so few parts around it hold them.
BEFORE, BEHIND = 10, 15
_LEAST = min(map(len, [*UNIT_VALUES, *MULTIPLIER_VALUES]))
_PARTS_BEFORE, _PARTS_BEHIND = -(-BEFORE // _LEAST), -(-BEHIND // _LEAST)


def span_pattern(grapheme: bool = False) -> str:
    """Runs of number words. By default vowel signs are no word characters, so words that end in one match only inside a run; ``grapheme`` mends that."""
    edge = boundary(r"[\p{L}\p{N}\p{M}_]" if grapheme else WORD_CHAR)
    listed = sorted([*UNIT_VALUES, *MULTIPLIER_VALUES], key=len, reverse=True)
    word = "(?:" + "|".join(listed) + ")"
    first = "".join(sorted({w[0] for w in listed}))  # other positions are passed by at the cost of one look
    return f"(?=[{first}]){edge}{word}(?:{WS}+{word})*{edge}"


def words_to_number(tokens: Column) -> Column:
    """Adds up units and tens, multiplies at multipliers; null for an unknown word, a total of 0 or beyond 38 digits."""
    table = F.create_map(*[F.lit(x) for w, v in (UNIT_VALUES | MULTIPLIER_VALUES).items() for x in (w, v)])
    dec = lambda c: c.cast("decimal(38,0)")
    start = F.struct(dec(F.lit(0)).alias("result"), dec(F.lit(0)).alias("current"), F.lit(True).alias("known"))

    def step(acc: Column, w: Column) -> Column:
        v = dec(F.try_element_at(table, w))
        base = F.when(acc.current == 0, dec(F.lit(1))).otherwise(acc.current)
        is_hundred, is_large = w == "सौ", w.isin([m for m in MULTIPLIER_VALUES if m != "सौ"])
        times = dec(F.try_multiply(base, v))
        result = F.when(is_large, dec(F.try_add(acc.result, times))).otherwise(acc.result)
        current = F.when(is_hundred, times).when(is_large, dec(F.lit(0))).otherwise(dec(F.try_add(acc.current, v)))
        return F.struct(result.alias("result"), current.alias("current"), (acc.known & v.isNotNull()).alias("known"))

    total = F.aggregate(tokens, start, step, lambda acc: F.when(acc.known, dec(F.try_add(acc.result, acc.current))))
    return F.when(total > 0, total)


def normalize_numbers(text: Column, grapheme: bool = False) -> Column:
    """struct(text, changes array<struct<original, converted, reason, skipped>>). A span near an idiom (10 characters before to 15 behind) stays."""
    gaps, spans = interleaved(text, span_pattern(grapheme))
    idiom = "|".join(p.replace(r"\s", WS) for p in IDIOMS)
    pairs = F.zip_with(gaps, spans, lambda g, s: F.struct(g.alias("gap"), s.alias("span")))
    whole = F.transform(pairs, lambda x: F.concat(x.gap, F.coalesce(x.span, F.lit(""))))

    def changed(x: Column, i: Column, all_parts: Column) -> Column:
        before = F.right(F.concat(F.array_join(F.slice(all_parts, F.greatest(i - _PARTS_BEFORE, F.lit(0)) + 1, F.least(i, F.lit(_PARTS_BEFORE))), ""), x.gap), F.lit(BEFORE))
        behind = F.left(F.array_join(F.slice(all_parts, i + 2, F.lit(_PARTS_BEHIND)), ""), F.lit(BEHIND))
        near = F.concat(before, x.span, behind).rlike(idiom)
        number = words_to_number(F.split(x.span, f"{WS}+")).cast("string")
        reason = F.when(near, "Idiomatic expression — preserved").otherwise(F.concat(F.lit("Standard number conversion: "), x.span, F.lit(" → "), number))
        record = F.struct(x.span.alias("original"), F.when(near, x.span).otherwise(number).alias("converted"), reason.alias("reason"), near.alias("skipped"))
        return F.struct(x.gap.alias("gap"), x.span.alias("span"), F.when(x.span.isNotNull(), record).alias("change"))

    # an array of one element names the parts, so that they are not computed again for each of them
    found = F.transform(F.array(whole), lambda w: F.transform(pairs, lambda x, i: changed(x, i, w)))[0]
    new = F.array_join(F.transform(found, lambda x: F.concat(x.gap, F.coalesce(x.change.converted, x.span, F.lit("")))), "")
    changes = F.transform(F.filter(found, lambda x: x.change.converted.isNotNull()), lambda x: x.change)
    return F.struct(new.alias("text"), changes.alias("changes"))
