"""License scans by sentence rules: normalised sentences map to known licence-sentence identifiers, and the sequence of
identifiers of a text is matched against ordered licence rules. DataFrame functions only; nothing is shuffled.

Sentences end at line breaks and at . ! ? ; before white space. Normalised: A-Z lower-cased, runs of white space to one
space, comment signs and quotes and white space at either end and a final . ! ? ; removed. A rule is a sequence of
identifiers that stand next to each other among the identifiers of the text (sentences without one between them do not
matter). Rules are tried in the order of WHOLE_RULES and RULES, longest texts first; identifiers that a rule used are spent.

Whole licence texts are wrapped, commented and go on after the phrases of SENTENCES. So the full sentences in WHOLE, and those
of SENTENCES but the titles and "all rights reserved", are also found across line breaks and comment signs, where they end
at . ! ? ; : or a line's end; what lies between them is split as above. The SQL reads SENTENCES and RULES line by line only,
so it finds fewer in such texts. SPDX tags name one licence; tags with OR, AND or WITH are not resolved.

Cases: null and empty texts have no sentences and no licences; repeated rows each get a row; an identifier that is found
more than once is listed as often, a licence once; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import ascii_lower, table, text_of

# Normalised licence sentences and the identifiers that they map to.
SENTENCES = {
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "mit license": "mit-title",
    "the mit license (mit)": "mit-title",
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"software\"), to deal in the software without restriction": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided \"as is\", without warranty of any kind": "as-is",
    "licensed under the apache license, version 2.0": "apache-ref",
    "licensed under the apache license, version 2.0 (the \"license\")": "apache-ref",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \"as is\" basis": "apache-as-is",
    "this work is licensed under the gnu general public license, version 3": "gpl3-ref",
    "licensed under the gnu general public license, version 3": "gpl3-ref",
    "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version": "gpl3-grant",
    "this program is distributed in the hope that it will be useful, but without any warranty": "gpl-warranty",
    "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice": "bsd-binary",
    "licensed under cc by-nc 4.0": "cc-by-nc-ref",
    "licensed under cc by 4.0": "cc-by-ref",
    "licensed under cc by-sa 4.0": "cc-by-sa-ref",
    "this work is dedicated to the public domain": "public-domain",
    "all rights reserved": "all-rights",
}
# Ordered rules, each a licence and the identifiers that it takes in sequence.
RULES = [
    ("MIT", ["mit-title", "mit-grant", "mit-notice", "as-is"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("Apache-2.0", ["apache-ref", "apache-comply", "apache-copy", "apache-as-is"]),
    ("GPL-3.0-or-later", ["gpl3-grant", "gpl-warranty"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit-ref"]),
    ("MIT", ["mit-title"]),
    ("Apache-2.0", ["apache-ref"]),
    ("GPL-3.0-only", ["gpl3-ref"]),
    ("GPL-3.0-or-later", ["gpl3-grant"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-ref"]),
    ("CC-BY-4.0", ["cc-by-ref"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-ref"]),
    ("public-domain", ["public-domain"]),
    ("proprietary", ["all-rights"]),
]
_GPL = "this {} free software{} you can redistribute it and/or modify it under the terms of the gnu {}general public license as published by the free software foundation{} either version {} of the license, or (at your option) any later version"
_USELESS = "this {} is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose"
# The full sentences of common licences, found across line breaks.
WHOLE = {
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"software\"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions": "mit-grant",
    "the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement": "as-is",
    "you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0": "apache-copy",
    "you may obtain a copy of the license at https://www.apache.org/licenses/license-2.0": "apache-copy",
    "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \"as is\" basis, without warranties or conditions of any kind, either express or implied": "apache-as-is",
    "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "bsd-source",
    "redistributions of source code must retain the above copyright notice, this list of conditions, and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "bsd-binary",
    "redistributions in binary form must reproduce the above copyright notice, this list of conditions, and the following disclaimer in the documentation and/or other materials provided with the distribution": "bsd-binary",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advert",
    "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this source code form is subject to the terms of the mozilla public license, v. 2.0": "mpl2-ref",
    "this is free and unencumbered software released into the public domain": "unlicense",
    **{
        _GPL.format(f"{what} is", a, kind, b, version): f"{name}{version}-grant"
        for what, kind, name, versions in (
            ("program", "", "gpl", ("2", "3")), ("library", "lesser ", "lgpl", ("2.1", "3")), ("program", "affero ", "agpl", ("3",)),
        )
        for version in versions
        for a, b in ((":", ","), (";", ";"))
    },
    **{_USELESS.format(what): "gpl-warranty" for what in ("program", "library")},
}
SPDX = [
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later",
    "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC0-1.0", "CC-BY-4.0",
    "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Unlicense",
]
_TEXTS = [
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    *[r for r in RULES if len(r[1]) > 1],
    ("AGPL-3.0-or-later", ["agpl3-grant", "gpl-warranty"]),
    ("LGPL-3.0-or-later", ["lgpl3-grant", "gpl-warranty"]),
    ("LGPL-2.1-or-later", ["lgpl2.1-grant", "gpl-warranty"]),
    ("GPL-2.0-or-later", ["gpl2-grant", "gpl-warranty"]),
    ("ISC", ["isc-grant"]),
]
# Before RULES; "all rights reserved" right before a licence text belongs to that text.
WHOLE_RULES = [
    *[(name, ["all-rights", *seq]) for name, seq in _TEXTS],
    *_TEXTS,
    *[(name, [x]) for name, x in (
        ("AGPL-3.0-or-later", "agpl3-grant"), ("LGPL-3.0-or-later", "lgpl3-grant"), ("LGPL-2.1-or-later", "lgpl2.1-grant"),
        ("GPL-2.0-or-later", "gpl2-grant"), ("MPL-2.0", "mpl2-ref"), ("Unlicense", "unlicense"),
    )],
    *[(name, [f"spdx-{name.lower()}"]) for name in SPDX],
]
ENDS = r"\n|[.!?;]+[\x20\x09-\x0D]+"
TRIM = " \t\n\x0b\f\r#/*\"'"
#: Between two words of a wrapped sentence: white space, line breaks and comment signs. Quotes as licence texts set them.
GAP = r"[\x20\x09-\x0D][\x20\x09-\x0D#/*;%>|-]*+"
QUOTE = "``|''|[\"\u201c\u201d]"
#: Stands around the wrapped sentences that were found.
MARK = "\x1e"


def _pattern(sentence: str) -> str:
    words = ["".join(f"(?:{QUOTE})" if c == '"' else c if c.isalnum() else "\\" + c for c in w) for w in sentence.split(" ")]
    return GAP.join(words)


def _wrapped() -> tuple[dict[str, str], str]:
    """The sentences found across line breaks with their identifiers, and the pattern that finds them, longest first."""
    known = {k: v for k, v in SENTENCES.items() if v not in ("mit-title", "all-rights")}
    any_of = lambda sentences: "|".join(map(_pattern, sorted(sentences, key=len, reverse=True)))
    begins = r"(?<=\A|\n|[.!?;][\x20\x09-\x0D]|(?:\A|[\n.!?;])[\x20\x09-\x0D#/*\"']{1,40})"
    ends = r"(?=[\x20\x09\x0D\"'*/]*+(?:[.!?;:]|\n|\z))"
    tags = {f"spdx-license-identifier: {x.lower()}": f"spdx-{x.lower()}" for x in SPDX}
    alone = r"(?![A-Za-z0-9+]|[.-][A-Za-z0-9]|[\x20\x09]++(?i:or|and|with)\b)"
    sought = f"(?<![A-Za-z0-9])(?:{any_of(WHOLE)}){ends}|{begins}(?:{any_of(known)}){ends}|(?<![A-Za-z0-9])(?:{any_of(tags)}){alone}"
    return {**known, **WHOLE, **tags}, rf"(?i)(\b(?=[a-z])(?:{sought}))"


WRAPPED, WRAPPED_PATTERN = _wrapped()


def normal(sentence: Column) -> Column:
    s = F.regexp_replace(ascii_lower(sentence), r"[\x20\x09-\x0D]+", " ")
    # Trims, as a pattern that ends in $ takes quadratic time over long runs of comment signs.
    return F.rtrim(F.rtrim(F.ltrim(s, F.lit(TRIM)), F.lit(TRIM)), F.lit(".!?;"))


def stems(sentences: list[str]) -> list[str]:
    """A few words, one of which at least each of the sentences holds: a text or line without any of them has none of the
    sentences. Found greedily: the word that most of the sentences left over hold, again and again; words of under six letters,
    which many texts hold, only where a sentence has no other."""
    words = [set(re.findall("[a-z0-9]+", x)) for x in sentences]
    left, out = [{w for w in x if len(w) > 5} or x for x in words], []
    while left:
        count = Counter(w for words in left for w in words)
        if not count:  # a sentence without a word
            return []
        best = max(sorted(count), key=lambda w: (count[w], len(w)))
        out.append(best)
        left = [words for words in left if best not in words]
    return out


def sentence_ids(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """The identifiers of a text's sentences in order."""
    known, whole = (F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) for d in (sentences, WRAPPED))
    # A cheap test spares most sentences the normalisation, and most texts everything: derived from the tables, it loses nothing.
    of_lines_test, of_text_test = ("|".join(stems(x)) or "" for x in (list(sentences), list(sentences) + list(WRAPPED)))

    def of_lines(part: Column) -> Column:
        near = F.filter(F.split(part, ENDS, -1), lambda s: s.rlike(f"(?i){of_lines_test}"))
        return F.transform(near, lambda s: F.try_element_at(known, normal(s)))

    def of_whole(part: Column) -> Column:
        s = F.regexp_replace(F.regexp_replace(ascii_lower(part), GAP, " "), QUOTE, '"')
        return F.array(F.try_element_at(whole, s))

    clean = F.translate(text, MARK, "\x1f")
    parts = F.split(F.regexp_replace(clean, WRAPPED_PATTERN, f"{MARK}$1{MARK}"), MARK, -1)
    ids = F.flatten(F.transform(parts, lambda part, i: F.when(i % 2 == 1, of_whole(part)).otherwise(of_lines(part))))
    return F.when(text.rlike(f"(?i){of_text_test}"), F.filter(ids, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def licences(ids: Column, rules: list = WHOLE_RULES + RULES) -> Column:
    """The distinct licences that the rules find, sorted. Identifiers stand as "<id>"; those that a rule used become "<>"."""
    ordered = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{x}>" for x in seq)).alias("sought")) for name, seq in rules])
    marked = F.concat_ws("", F.transform(ids, lambda x: F.concat(F.lit("<"), x, F.lit(">"))))
    none = F.array().cast("array<string>")
    start = F.struct(marked.alias("rest"), none.alias("found"))

    def step(state: Column, rule: Column) -> Column:
        hit = F.when(F.contains(state["rest"], rule["sought"]), F.array(rule["name"])).otherwise(none)
        return F.struct(F.replace(state["rest"], rule["sought"], F.lit("<>")).alias("rest"), F.concat(state["found"], hit).alias("found"))

    found = F.aggregate(ordered, start, step, lambda state: F.array_sort(F.array_distinct(state["found"])))
    return F.when(F.size(ids) > 0, found).otherwise(none)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids and licences, both joined by commas."""
    found = docs.select("doc_id", sentence_ids(text_of(text)).alias("ids"))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(licences(F.col("ids")), ",").alias("licences"),
    )


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def oracle() -> str:
    """The same in SQL: sentences, identifiers, then the rules one after the other over the marked sequence."""
    known = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in SENTENCES.items())
    trim = "[\\x20\\x09-\\x0D#/*\"'']"
    steps, left = [], "marked"
    for i, (_, ids) in enumerate(RULES):
        sought = _quoted("".join(f"<{x}>" for x in ids))
        steps.append(f"m{i} AS (SELECT *, contains({left}, {sought}) AS hit{i}, replace({left}, {sought}, '<>') AS left{i} FROM {'marks' if not i else f'm{i - 1}'})")
        left = f"left{i}"
    hits = ", ".join(f"CASE WHEN hit{i} THEN {_quoted(name)} END" for i, (name, _) in enumerate(RULES))
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
s AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\\n|[.!?;]+[\\x20\\x09-\\x0D]+')) AS s,
  generate_subscripts(string_split_regex(coalesce(text, ''), '\\n|[.!?;]+[\\x20\\x09-\\x0D]+'), 1) AS i FROM documents),
n AS (SELECT doc_id, i, regexp_replace(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\\x20\\x09-\\x0D]+', ' ', 'g'), '^{trim}+|[.!?;]*{trim}*$', '', 'g') AS sentence FROM s),
f AS (SELECT doc_id, i, id FROM n JOIN known USING (sentence)),
marks AS (SELECT d.doc_id, count(id)::BIGINT AS n_sentences, coalesce(string_agg(id, ',' ORDER BY i), '') AS sentence_ids,
  coalesce(string_agg('<' || id || '>', '' ORDER BY i), '') AS marked FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id),
{", ".join(steps)}
SELECT doc_id, n_sentences, sentence_ids, array_to_string(list_sort(list_distinct(list_filter([{hits}], lambda x: x IS NOT NULL))), ',') AS licences
FROM m{len(RULES) - 1}
"""
