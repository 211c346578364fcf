"""License scans by ordered signature rules, in DataFrame functions only.

A rule is a regex on the text with A-Z lower-cased, a keyword without which it can't
match, a label, a priority (1 is strongest) and a confidence.  A document that
holds none of the gate's words runs no regex; of the others only rules whose
keyword occurs are tried.  A detection is suppressed if another of the same or a
stronger priority contains its interval (of equal intervals the earlier rule
stays).  Rules are a literal, so nothing is joined or shuffled: every document is
judged where it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchflow.llm.common import WORD_PATTERN, lower_ascii

#: Phrases and labels of the base count.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Hand-written signatures of licenses: label, keyword, regex of the name.
NAMES = [
    ("mit", "mit", r"(?:the )?mit(?:/x11| \(expat\))?"),
    ("mit-0", "mit", r"mit-0|mit no attribution"),
    ("apache-2.0", "apache", r"(?:the )?apache(?: software)?[ -]?(?:license[, -]+)?(?:version |v)?2(?:\.0)?"),
    ("apache-1.1", "apache", r"(?:the )?apache(?: software)?[ -]?(?:license[, -]+)?(?:version |v)?1\.1"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl[ -]?(?:version |v)?2(?:\.0)?(?:[ -]only)?"),
    ("gpl-2.0-or-later", "gpl", r"(?:gnu )?gpl[ -]?(?:version |v)?2(?:\.0)?(?:\+|[ -]or[ -]later)"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl[ -]?(?:version |v)?3(?:\.0)?(?:[ -]only)?"),
    ("gpl-3.0-or-later", "gpl", r"(?:gnu )?gpl[ -]?(?:version |v)?3(?:\.0)?(?:\+|[ -]or[ -]later)"),
    ("gpl-2.0", "general public", r"(?:the )?gnu general public license,? (?:version |v)2(?:\.0)?"),
    ("gpl-3.0", "general public", r"(?:the )?gnu general public license,? (?:version |v)3(?:\.0)?"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl[ -]?(?:version |v)?2\.1(?:[ -](?:only|or[ -]later)|\+)?"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl[ -]?(?:version |v)?3(?:\.0)?(?:[ -](?:only|or[ -]later)|\+)?"),
    ("lgpl", "lesser general", r"(?:the )?gnu lesser general public license"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl[ -]?(?:version |v)?3(?:\.0)?(?:[ -](?:only|or[ -]later)|\+)?"),
    ("agpl-3.0", "affero", r"(?:the )?gnu affero general public license"),
    ("bsd-2-clause", "bsd", r"(?:the )?(?:simplified |freebsd )?bsd[ -]2[ -]clause|2[ -]clause bsd|simplified bsd"),
    ("bsd-3-clause", "bsd", r"(?:the )?(?:new |modified |revised )bsd|bsd[ -]3[ -]clause|3[ -]clause bsd"),
    ("bsd-4-clause", "bsd", r"(?:the )?original bsd|bsd[ -]4[ -]clause|4[ -]clause bsd"),
    ("0bsd", "bsd", r"0bsd|zero[ -]clause bsd"),
    ("isc", "isc", r"(?:the )?isc"),
    ("mpl-2.0", "mpl", r"mpl[ -]?(?:version |v)?2(?:\.0)?"),
    ("mpl-2.0", "mozilla", r"(?:the )?mozilla public(?: license)?,? (?:version |v)?2(?:\.0)?"),
    ("mpl-1.1", "mozilla", r"(?:the )?mozilla public(?: license)?,? (?:version |v)?1\.1"),
    ("epl-2.0", "eclipse", r"(?:the )?eclipse public(?: license)?[ ,-]*(?:version |v)?2(?:\.0)?"),
    ("epl-1.0", "eclipse", r"(?:the )?eclipse public(?: license)?[ ,-]*(?:version |v)?1(?:\.0)?"),
    ("cddl-1.0", "cddl", r"cddl(?:[ -]?(?:version |v)?1(?:\.0)?)?"),
    ("cddl-1.0", "common development", r"common development and distribution"),
    ("cc0-1.0", "cc0", r"cc0(?:[ -]?1\.0)?(?: universal)?"),
    ("cc-by-4.0", "cc", r"cc[ -]by[ -]4\.0"),
    ("cc-by-3.0", "cc", r"cc[ -]by[ -]3\.0"),
    ("cc-by-sa-4.0", "cc", r"cc[ -]by-sa[ -]4\.0"),
    ("cc-by-sa-3.0", "cc", r"cc[ -]by-sa[ -]3\.0"),
    ("cc-by-nc-4.0", "cc", r"cc[ -]by-nc[ -]4\.0"),
    ("cc-by-nd-4.0", "cc", r"cc[ -]by-nd[ -]4\.0"),
    ("cc-by-nc-sa-4.0", "cc", r"cc[ -]by-nc-sa[ -]4\.0"),
    ("cc-by-nc-nd-4.0", "cc", r"cc[ -]by-nc-nd[ -]4\.0"),
    ("cc-by", "creative commons", r"(?:the |a )?creative commons attribution(?! ?-?(?:share|non|no))"),
    ("cc-by-sa", "creative commons", r"(?:the |a )?creative commons attribution[ -]share[ -]?alike"),
    ("cc-by-nc", "creative commons", r"(?:the |a )?creative commons attribution[ -]non[ -]?commercial"),
    ("cc-by-nd", "creative commons", r"(?:the |a )?creative commons attribution[ -]no[ -]?derivatives"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("zlib", "zlib", r"(?:the )?zlib(?:/libpng)?"),
    ("bsl-1.0", "boost", r"(?:the )?boost software(?: license)?"),
    ("artistic-2.0", "artistic", r"(?:the )?artistic(?: license)?[ ,-]*(?:version |v)?2(?:\.0)?"),
    ("artistic-1.0", "artistic", r"(?:the )?artistic(?: license)?[ ,-]*(?:version |v)?1(?:\.0)?"),
    ("ofl-1.1", "open font", r"(?:the )?sil open font"),
    ("odbl-1.0", "open database", r"(?:the )?open database"),
    ("eupl-1.2", "eupl", r"eupl[ -]?(?:version |v)?1\.2"),
    ("ms-pl", "microsoft public", r"(?:the )?microsoft public"),
    ("ms-rl", "microsoft reciprocal", r"(?:the )?microsoft reciprocal"),
    ("postgresql", "postgresql", r"(?:the )?postgresql"),
    ("python-2.0", "python software", r"(?:the )?python software foundation"),
    ("ruby", "ruby", r"(?:the )?ruby"),
    ("php-3.01", "php", r"(?:the )?php(?: license)?,? (?:version |v)?3\.01"),
    ("upl-1.0", "universal permissive", r"(?:the )?universal permissive"),
    ("bsl-1.1", "business source", r"(?:the )?business source(?: license)?"),
    ("sspl-1.0", "server side public", r"(?:the )?server side public"),
]

#: Ways a text names a license: regex around the name, priority, confidence.
FORMS = [
    (r"spdx-license-identifier:\s*(?:{})(?![\w.-])", 1, 1.0),
    (r"licen[sc]ed under (?:the terms of )?(?:the )?(?:{})(?: licen[sc]e)?(?![\w-])", 2, 0.95),
    (r"(?:released|distributed|published|available|provided) under (?:the terms of )?(?:the )?(?:{})(?: licen[sc]e)?(?![\w-])", 2, 0.9),
    (r"licen[sc]e:\s*(?:{})(?![\w-])", 2, 0.9),
    (r"(?<![\w-])(?:{}) licen[sc]e(?:[, ]+(?:version |v)[0-9.]*[0-9])?", 3, 0.8),
    (r"licen[sc]e \((?:{})\)", 3, 0.8),
]

#: Hand-written signatures of license texts: label, keyword, regex, priority, confidence.
TEXTS = [
    ("mit", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a\s+copy", 1, 1.0),
    ("isc", "permission to use", r"permission to use, copy, modify, and(?:/or)? distribute this software for any\s+purpose", 1, 0.95),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms, with or without\s+modification", 1, 0.95),
    ("bsd-3-clause", "neither the name", r"neither the names? of [^.]{0,200}? may be used to endorse or promote products", 1, 0.95),
    ("bsd-4-clause", "all advertising materials", r"all advertising materials mentioning features or use of this software", 1, 0.95),
    ("apache-2.0", "apache.org/licenses", r"https?://www\.apache\.org/licenses/license-2\.0(?:\.txt|\.html)?", 1, 1.0),
    ("gpl", "free software foundation", r"under the terms of the gnu general public license as published by\s+the free software foundation", 1, 0.95),
    ("gpl", "general public license", r"gnu general public license", 4, 0.6),
    ("gpl-3.0", "gnu.org/licenses", r"https?://www\.gnu\.org/licenses/gpl-3\.0[.\w]*", 1, 1.0),
    ("gpl-2.0", "gnu.org/licenses", r"https?://www\.gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0[.\w]*", 1, 1.0),
    ("lgpl", "gnu.org/licenses", r"https?://www\.gnu\.org/licenses/(?:old-licenses/)?lgpl[-\w.]*", 1, 1.0),
    ("mpl-2.0", "mozilla.org/mpl", r"https?://(?:www\.)?mozilla\.org/mpl/2\.0", 1, 1.0),
    ("cc0-1.0", "creativecommons.org/publicdomain", r"https?://creativecommons\.org/publicdomain/zero/1\.0", 1, 1.0),
    ("cc-by", "creativecommons.org/licenses", r"https?://creativecommons\.org/licenses/by/[0-9.]*[0-9]", 1, 1.0),
    ("cc-by-sa", "creativecommons.org/licenses", r"https?://creativecommons\.org/licenses/by-sa/[0-9.]*[0-9]", 1, 1.0),
    ("cc-by-nc", "creativecommons.org/licenses", r"https?://creativecommons\.org/licenses/by-nc/[0-9.]*[0-9]", 1, 1.0),
    ("unlicense", "free and unencumbered", r"this is free and unencumbered software released into the public domain", 1, 1.0),
    ("public-domain", "public domain", r"(?:released|placed|dedicated) (?:in|to|into) the public domain", 2, 0.9),
    ("wtfpl", "do what the fuck", r"do what the fuck you want to public licen[sc]e", 1, 1.0),
    ("zlib", "as-is", r"this software is provided 'as-is', without any express or implied\s+warranty", 1, 0.9),
    ("proprietary", "all rights reserved", r"all rights reserved", 4, 0.3),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)", 2, 0.8),
    ("proprietary", "unauthori", r"unauthori[sz]ed (?:copying|reproduction|distribution)[^.]{0,120}? (?:strictly )?prohibited", 2, 0.8),
]

#: No rule matches a text without one of these.
GATE = ("licen", "permission", "redistribution", "free software", "creativecommons.org", "gnu.org", "mozilla.org",
        "public domain", "neither the name", "all advertising", "all rights reserved", "as-is", "confidential",
        "unauthori", "released under ", "distributed under ", "published under ", "available under ", "provided under ")


def rules() -> list[tuple[str, str, str, int, float]]:
    """All rules in order: (keyword, regex, label, priority, confidence)."""
    named = [(keyword, form.format(name), label, priority, confidence)
             for form, priority, confidence in FORMS for label, keyword, name in NAMES]
    return [(k, r, label, p, c) for label, k, r, p, c in TEXTS] + named


_OPEN, _SHUT = "\u0001", "\u0002"


def _spans(text: Column, regex: Column) -> Column:
    """Start and end of every match: matches are fenced, the text is cut at the fences, lengths are summed."""
    parts = F.split(F.regexp_replace(text, regex, F.lit(f"{_OPEN}$0{_SHUT}")), f"[{_OPEN}{_SHUT}]", -1)
    empty = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), empty.alias("spans"))

    def step(s: Column, part: Column) -> Column:
        end = s["at"] + F.length(part)
        span = F.struct(s["at"].alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), (s["n"] + 1).alias("n"),
                        F.when(s["n"] % 2 == 1, F.array_append(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(parts, start, step, lambda s: s["spans"])


def detections(text: Column, ruleset: list[tuple[str, str, str, int, float]] | None = None) -> Column:
    """Array of kept ``(start, end, label, priority, confidence)`` of a text with A-Z lower-cased."""
    ruleset = rules() if ruleset is None else ruleset
    table = F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(r).alias("regex"), F.lit(label).alias("label"),
                               F.lit(p).alias("priority"), F.lit(float(c)).alias("confidence"), F.lit(i).alias("rule"))
                      for i, (k, r, label, p, c) in enumerate(ruleset)])
    levels = max(p for _, _, _, p, _ in ruleset)

    def tried(r: Column) -> Column:
        return F.transform(_spans(text, r["regex"]), lambda s: F.struct(
            s["start"].alias("start"), (-s["end"]).alias("minus_end"), r["priority"].alias("priority"),
            r["rule"].alias("rule"), r["label"].alias("label"), r["confidence"].alias("confidence")))

    found = F.array_sort(F.flatten(F.transform(F.filter(table, lambda r: F.contains(text, r["keyword"])), tried)))
    kept_type = "array<struct<start:int,end:int,label:string,priority:int,confidence:double>>"
    start = F.struct(F.array(*[F.lit(-1)] * levels).alias("ends"), F.array().cast(kept_type).alias("kept"))

    def step(s: Column, h: Column) -> Column:
        # in this order, what contains h came before it: look at the furthest end per priority
        end = -h["minus_end"]
        inside = F.exists(F.slice(s["ends"], F.lit(1), h["priority"]), lambda e: e >= end)
        hit = F.struct(h["start"].alias("start"), end.alias("end"), h["label"].alias("label"),
                       h["priority"].alias("priority"), h["confidence"].alias("confidence"))
        ends = F.transform(s["ends"], lambda e, i: F.when(i == h["priority"] - 1, F.greatest(e, end)).otherwise(e))
        return F.struct(ends.alias("ends"),
                        F.when(inside, s["kept"]).otherwise(F.array_append(s["kept"], hit)).alias("kept"))

    return F.aggregate(found, start, step, lambda s: s["kept"])


def _base_places(words: Column, phrases: dict[str, str]) -> Column:
    """Array of ``(start, label)`` where a phrase's words stand consecutively."""
    split = {label: phrase.split() for phrase, label in phrases.items()}

    def ending(w: Column, i: Column) -> Column:
        cases = []
        for label, p in split.items():
            whole = w == p[-1]
            for back, word in enumerate(reversed(p[:-1]), 1):
                whole = whole & (F.get(words, i - back) == word)
            cases.append(F.when(whole, F.struct((i - (len(p) - 1)).cast("long").alias("start"), F.lit(label).alias("label"))))
        none = F.array().cast("array<struct<start:bigint,label:string>>")
        return F.when(w.isin([p[-1] for p in split.values()]), F.filter(F.array(*cases), F.isnotnull)).otherwise(none)

    return F.flatten(F.transform(words, ending))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 phrases: dict[str, str] | None = None) -> DataFrame:
    """Per document: word and phrase counts, labels, score and the kept detections.

    ``score`` is the largest confidence of a kept detection (0.5 at least where a
    phrase stands, 0 without any find).  Null texts count as empty; ids may be
    null or repeated, each row is judged by itself; an empty table gives no rows.
    """
    phrases = BASE if phrases is None else phrases
    text = F.translate(lower_ascii(F.coalesce(docs[text_col], F.lit(""))), _OPEN + _SHUT, "  ")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0)))
    gated = F.greatest(*[F.contains(F.col("text"), F.lit(g)) for g in GATE])
    worded = F.greatest(*[F.contains(F.col("text"), F.lit(p.split()[-1])) for p in phrases], F.lit(False))
    no_base = F.array().cast("array<struct<start:bigint,label:string>>")
    no_hits = F.array().cast("array<struct<start:int,end:int,label:string,priority:int,confidence:double>>")
    rows = rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        F.when(worded, _base_places(F.col("words"), phrases)).otherwise(no_base).alias("base"),
        F.when(gated, detections(F.col("text"))).otherwise(no_hits).alias("detections"))
    starts, labels = F.col("base.start"), F.array_sort(F.array_distinct(F.col("base.label")))
    found = F.array_sort(F.array_union(F.col("base.label"), F.col("detections.label")))
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), F.array_join(labels, ",").alias("base_labels"),
        F.array_join(found, ",").alias("labels"),
        F.coalesce(F.greatest(F.array_max(F.col("detections.confidence")), F.when(F.size("base") > 0, 0.5)), F.lit(0.0)).alias("score"),
        "detections")

