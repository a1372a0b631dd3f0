"""License scans by ordered signature rules, in DataFrame functions only.

The text becomes lower-case words parted by single spaces.  A rule is a
pattern over such words with a priority, a label, a score and a keyword.  Only
texts with one of a few trigger words meet the rules, and a rule's pattern is
tried only where its keyword occurs.  Every match is a detection, an interval
of words.  A detection inside the interval of another is suppressed by one of
smaller priority number, or of the same priority that is longer (or as long
with the smaller label).  No row leaves its partition: there is no shuffle.

Defined results: null and empty texts have no words and no places, first_word
and last_word null, empty labels, score 0; repeated rows each get a result; a
null id stays null; an empty table gives an empty table; extra columns, also
of clashing names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.cluster import private

#: Base phrases and their labels (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BASE_SCORE = 0.6

#: Families: label, name in words as a pattern, keyword that every match has, versions (fixed values).
FAMILIES = [
    ("agpl", r"(?:gnu )?(?:affero general public licen[cs]e|agpl)", "", ("1 0", "3 0")),
    ("lgpl", r"(?:gnu )?(?:(?:lesser|library) general public licen[cs]e|lgpl)", "", ("2 0", "2 1", "3 0")),
    ("gpl", r"(?:gnu )?(?:general public licen[cs]e|gpl)", "", ("1 0", "2 0", "3 0")),
    ("gfdl", r"(?:gnu )?free documentation licen[cs]e", "free documentation", ("1 1", "1 2", "1 3")),
    ("apache", r"apache(?: software)?(?: foundation)? licen[cs]e", "apache", ("1 0", "1 1", "2 0")),
    ("mpl", r"mozilla public licen[cs]e", "mozilla", ("1 0", "1 1", "2 0")),
    ("epl", r"eclipse public licen[cs]e", "eclipse", ("1 0", "2 0")),
    ("cpl", r"common public licen[cs]e", "common public", ("0 5", "1 0")),
    ("cddl", r"common development and distribution licen[cs]e", "common development", ("1 0", "1 1")),
    ("eupl", r"european union public licen[cs]e", "european union", ("1 0", "1 1", "1 2")),
    ("artistic", r"artistic licen[cs]e", "artistic", ("1 0", "2 0")),
    ("ofl", r"(?:sil )?open font licen[cs]e", "open font", ("1 0", "1 1")),
    ("boost", r"boost software licen[cs]e", "boost", ("1 0",)),
    ("afl", r"academic free licen[cs]e", "academic free", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("osl", r"open software licen[cs]e", "open software", ("1 0", "2 0", "2 1", "3 0")),
    ("lppl", r"latex project public licen[cs]e", "latex project", ("1 0", "1 2", "1 3")),
    ("odbl", r"open (?:data commons open )?database licen[cs]e", "database licen", ("1 0",)),
    ("psf", r"python software foundation licen[cs]e", "python software", ("2 0",)),
    ("php", r"php licen[cs]e", "php licen", ("3 0", "3 01")),
    ("zpl", r"zope public licen[cs]e", "zope", ("1 1", "2 0", "2 1")),
    ("apsl", r"apple public source licen[cs]e", "apple public", ("1 0", "1 1", "1 2", "2 0")),
    ("ipl", r"ibm public licen[cs]e", "ibm public", ("1 0",)),
    ("qpl", r"q public licen[cs]e", "q public", ("1 0",)),
    ("wtfpl", r"do what the fuck you want to public licen[cs]e", "you want to public", ("1 0", "2 0")),
    ("bsl", r"business source licen[cs]e", "business source", ("1 0", "1 1")),
    ("mulan", r"mulan (?:permissive software |psl )?licen[cs]e", "mulan", ("1 0", "2 0")),
]
#: Licenses without versions: label, pattern, keyword (fixed values).
PLAIN = [
    ("mit", r"(?:the )?(?:mit|expat) licen[cs]e", "licen"),
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby"),
    ("isc", r"(?:the )?isc licen[cs]e", "isc licen"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("zlib", r"zlib(?: libpng)? licen[cs]e", "zlib"),
    ("unlicense", r"the unlicense", "unlicen"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered"),
    ("public-domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain", "public domain"),
    ("cc0", r"cc0(?: 1 0)?(?: universal)?", "cc0"),
    ("ncsa", r"university of illinois(?: ncsa)? open source licen[cs]e", "university of illinois"),
    ("postgresql", r"postgresql licen[cs]e", "postgresql"),
    ("openssl", r"openssl licen[cs]e", "openssl"),
    ("ruby", r"ruby licen[cs]e", "ruby licen"),
    ("vim", r"vim licen[cs]e", "vim licen"),
    ("x11", r"x11 licen[cs]e", "x11"),
    ("curl", r"curl licen[cs]e", "curl licen"),
    ("ms-pl", r"microsoft public licen[cs]e", "microsoft public"),
    ("ms-rl", r"microsoft reciprocal licen[cs]e", "microsoft reciprocal"),
    ("copyright", r"copyright (?:c )?[0-9]{4}", "copyright"),
    ("no-warranty", r"provided as is without warranty of any kind", "without warranty"),
    ("permissive", r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use"),
    ("reserved", r"all rights (?:are )?reserved", "rights"),
]
#: A text meets the rules if it has one of these; every rule needs one of them to match.
TRIGGERS = ("licen", "gpl", "bsd", "cc by", "cc attribution", "cc0", "creative commons", "spdx", "rights", "copyright", "public domain", "without warranty", "with or without", "permission is hereby")
_UNDER = r"(?:(?:is |are )?(?:licen[cs]ed|released|distributed|published|available|covered) under (?:the )?(?:terms of (?:the )?)?)?"
_BY = (("by", "by|attribution"), ("by-sa", "by sa|attribution share ?alike"), ("by-nd", "by nd|attribution no ?derivs"), ("by-nc", "by nc|attribution non ?commercial"), ("by-nc-sa", "by nc sa|attribution non ?commercial share ?alike"), ("by-nc-nd", "by nc nd|attribution non ?commercial no ?derivs"))


def rules() -> list[tuple[int, str, str, str, float]]:
    """(priority, label, keyword, pattern, score) of every rule, built from the families above."""
    out = []
    for label, name, keyword, versions in FAMILIES:
        for v in versions:
            number = rf"(?:(?: (?:version|v))? v?|v){v.replace(' 0', '(?: 0)?')}"
            dotted = f"{label}-{v.replace(' ', '.')}"
            out.append((0, dotted, "spdx", rf"spdx license identifier {label} {v}(?: only)?", 1.0))
            out.append((0, f"{dotted}-or-later", "spdx", rf"spdx license identifier {label} {v} or later", 1.0))
            out.append((1, f"{dotted}-or-later", keyword, rf"{_UNDER}{name}(?: as published by the free software foundation)?(?: either)?{number} or (?:at your option )?(?:any )?later(?: version)?", 0.99))
            out.append((2, f"{dotted}-only", keyword, rf"{_UNDER}{name}{number} only", 0.98))
            out.append((3, dotted, keyword, rf"{_UNDER}{name}{number}", 0.95))
        out.append((5, label, keyword, rf"{_UNDER}{name}", 0.8))
    for kind, words in _BY:
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            dotted = f"cc-{kind}-{v.replace(' ', '.')}"
            out.append((0, dotted, "spdx", rf"spdx license identifier cc {kind.replace('-', ' ')} {v}", 1.0))
            out.append((3, dotted, "c", rf"{_UNDER}(?:cc|creative commons) (?:{words})(?: (?:licen[cs]e|international|unported|generic))? (?:version |v)?{v}(?: (?:international|unported|generic))?(?: licen[cs]e)?", 0.95))
            out.append((4, dotted, "creativecommons", rf"creativecommons org licenses {kind.replace('-', ' ')} {v}", 0.97))
        out.append((5, f"cc-{kind}", "c", rf"{_UNDER}(?:cc|creative commons) (?:{words})(?: licen[cs]e)?", 0.8))
    for n, word in (("0", "zero"), ("2", "two"), ("3", "three"), ("4", "four")):
        out.append((0, f"bsd-{n}-clause", "spdx", rf"spdx license identifier bsd {n} clause", 1.0))
        out.append((3, f"bsd-{n}-clause", "bsd", rf"{_UNDER}(?:{n}|{word}) clause bsd licen[cs]e", 0.95))
        out.append((3, f"bsd-{n}-clause", "bsd", rf"{_UNDER}bsd (?:{n}|{word}) clause(?: licen[cs]e)?", 0.95))
    out.append((5, "bsd", "bsd", rf"{_UNDER}bsd (?:style )?licen[cs]e", 0.8))
    out += [(3, label, keyword, rf"{_UNDER}(?:{pattern})", 0.9) for label, pattern, keyword in PLAIN]
    return out


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _literal(rows: list[tuple[int, str, str, str, float]]) -> Column:
    fields = ("priority", "label", "keyword", "pattern", "score")
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(fields, r, strict=True)]) for r in rows])


def _hits(norm: Column, rule: Column) -> Column:
    """The detections of one rule: array<struct<priority, label, score, start, end>>, in words, end exclusive."""
    whole = F.concat(F.lit("(?<![^ ])(?:"), rule["pattern"], F.lit(")(?![^ ])"))
    parts = F.split(F.regexp_replace(norm, whole, F.lit("\u0001$0\u0002")), "\u0001")
    none = F.filter(F.array(F.struct(rule["priority"].alias("priority"), rule["label"].alias("label"), rule["score"].alias("score"), F.lit(0).alias("start"), F.lit(0).alias("end"))), lambda _: F.lit(False))

    def add(acc: Column, part: Column) -> Column:
        size = _spaces(F.substring_index(part, "\u0002", 1)) + 1
        hit = F.struct(rule["priority"].alias("priority"), rule["label"].alias("label"), rule["score"].alias("score"), acc["at"].alias("start"), (acc["at"] + size).alias("end"))
        return F.struct((acc["at"] + _spaces(part)).alias("at"), F.concat(acc["hits"], F.array(hit)).alias("hits"))

    start = F.struct(_spaces(parts[0]).alias("at"), none.alias("hits"))
    return F.when(F.size(parts) > 1, F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), start, add)["hits"]).otherwise(none)


def _outranked(a: Column, b: Column) -> Column:
    longer, same = (b["end"] - b["start"]) > (a["end"] - a["start"]), (b["end"] - b["start"]) == (a["end"] - a["start"])
    inside = (b["start"] <= a["start"]) & (b["end"] >= a["end"])
    return inside & ((b["priority"] < a["priority"]) | ((b["priority"] == a["priority"]) & (longer | (same & (b["label"] < a["label"])))))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df = private(docs, {"doc_id": id_col, "text": text_col})
    df = df.select("doc_id", F.trim(F.regexp_replace(text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")).alias("norm"))
    norm = F.col("norm")
    padded = F.concat(F.lit(" "), norm, F.lit(" "))
    places = []
    for phrase, label in BASE.items():
        parts = F.split(padded, f"(?<= ){phrase}(?= )")
        n = F.size(parts) - 1
        last = _spaces(padded) - _spaces(F.element_at(parts, -1)) - phrase.count(" ") - 1
        found = F.struct(F.lit(label).alias("label"), n.cast("long").alias("n"), (_spaces(parts[0]) - 1).cast("long").alias("first"), last.cast("long").alias("last"))
        places.append(F.when(F.contains(padded, F.lit(f" {phrase} ")), found))
    table = _literal(rules())
    empty = F.expr("cast(array() as array<struct<priority:int,label:string,score:double,start:int,end:int>>)")
    triggered = F.exists(F.array(*[F.lit(t) for t in TRIGGERS]), lambda t: F.contains(norm, t))
    live = F.filter(table, lambda r: F.contains(norm, r["keyword"]))
    df = df.withColumns({"places": F.array_compact(F.array(*places)), "all": F.when(triggered, F.flatten(F.transform(live, lambda r: _hits(norm, r)))).otherwise(empty)})
    df = df.withColumn("detections", F.filter("all", lambda a: ~F.exists("all", lambda b: _outranked(a, b))))
    base_labels = F.array_distinct(F.transform("places", lambda p: p["label"]))
    labels = F.array_distinct(F.concat(base_labels, F.transform("detections", lambda d: d["label"])))
    total = F.aggregate("places", F.lit(0).cast("long"), lambda acc, p: acc + p["n"])
    best = F.array_max(F.concat(F.transform("detections", lambda d: d["score"]), F.when(F.size("places") > 0, F.array(F.lit(BASE_SCORE))).otherwise(F.array(F.lit(0.0)))))
    return df.select(
        "doc_id",
        F.when(norm == "", F.lit(0)).otherwise(_spaces(norm) + 1).cast("long").alias("n_words"),
        total.alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["first"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["last"])).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        best.alias("score"),
        "detections",
    )
