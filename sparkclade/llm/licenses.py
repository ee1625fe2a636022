"""License scans: canonical digest lookup of entire texts.

A text is brought to a canonical form: case, punctuation and white space,
copyright lines and equivalent spellings no longer count.  The digest of the form
is looked up among those of known licences, by a hash join on a table whose size
is that of the list below.  Only an entire text is a licence; a text that quotes
one is not.  A known title before a licence's first words, and the advice on how to
apply a licence after its end, may be there or not.

A null or empty text matches nothing; repeated rows are matched each; a licence
table with repeated (tied) digests gives the smallest name; an empty table gives an
empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import pkgutil
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licence texts and notices, entire.
KNOWN = {
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-notice": "Released under the MIT License.",
}

# Spellings that licence matching guidelines take as equal.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "acknowledgement": "acknowledgment", "analogue": "analog", "authorisation": "authorization", "authorised": "authorized",
    "favour": "favor", "fulfil": "fulfill", "organisation": "organization", "recognise": "recognize", "noncommercial": "non commercial", "copyright owner": "copyright holder", "copyright owners": "copyright holders",
}

#: Longer texts, as files beside this module.
FILES = ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense")
KNOWN |= {name: pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode() for name in FILES}

# Words that follow 'copyright', or the mark (c) of a list, where no holder is named.
NO_HOLDER = """a also an and any are as at be but by claim claims disclaimer disclaimers doctrines each for from has held holder holders if in interest
interests is it its law laws licence licences license licenses like line lines no nor not notice notices of on or otherwise owner owners ownership
patent permission permissions protection right rights shall statement statements such that the then these this those to trademark treaty under use
when where which will with you your""".split()


def _other_word(words: set[str], first: bool = True) -> str:
    """Pattern for how a word begins that is none of `words`; it needs no look-ahead, which RE2 lacks."""
    heads = sorted({w[0] for w in words if w})
    if first or "" in words:
        free = "[" + "".join(c for c in "abcdefghijklmnopqrstuvwxyz0123456789" if c not in heads) + "]"
    else:
        free = "[^" + "".join(heads) + r"\n]"
    return "(" + "|".join([free, *(h + _other_word({w[1:] for w in words if w[:1] == h}, False) for h in heads)]) + ")"


_NAME = rf"({_other_word(set(NO_HOLDER))}|the[^\n]*[^a-z0-9\n](authors|contributors|developers|foundation|project|regents|team))"
#: Whole lines that only say who has the copyright.
COPYRIGHT_LINE = rf"(^|\n)[^a-z0-9\n]*(copyright[^a-z0-9\n]*(\(c\)|©)|copyright[^a-z0-9\n]+{_NAME}|\(c\)[^a-z0-9\n]*(copyright|[^\n]*(19|20)[0-9][0-9]|{_NAME})|©|all rights reserved)[^\n]*"

# Fixed values, in canonical form: titles, and the first words of the licences that have them.
TITLES = [
    (r"mit license( mit| expat)?|expat license( mit)?", "permission is hereby granted free of charge to any person"),
    (r"isc license( isc| iscl)?|bsd zero clause license|zero clause bsd( license)?|0bsd( license)?|free public license 1 0 0", "permission to use copy modify and or distribute this software"),
    (r"zlib license|zlib libpng license", "this software is provided as is without any express or implied warranty"),
    (r"bsd license|(bsd [23] clause|[23] clause bsd|simplified bsd|freebsd|new bsd|modified bsd|revised bsd|bsd [23] clause simplified|bsd [23] clause new or revised)( license)?", "redistribution and use in source and binary forms"),
    (r"unlicense", "this is free and unencumbered software"),
]


# Addresses of the licences themselves, by either scheme.
ADDRESSES = [(f"{a} https {b}", f"{a} http {b}") for a, b in (("please refer to", "unlicense org"), ("obtain one at", "mozilla org mpl 2 0"), ("version 2 0 january 2004", "www apache org licenses"))]


def _form(text: str, steps: list[tuple[str, str]]) -> str:
    out = text.translate({k: k + 32 for k in range(65, 91)})
    for pattern, to in steps:
        out = re.sub(pattern, to, out)
    return out


def _advice(steps: list[tuple[str, str]]) -> list[str]:
    """What the known texts have after their end, on how to apply them, by either scheme of its addresses."""
    found = (re.split("END OF TERMS AND CONDITIONS", v)[1:] for v in KNOWN.values())
    return [re.sub(r"\bhttps?\b", "https?", _form(v[0], steps).strip()) for v in found if v and v[0].strip()]


def canonical_steps() -> list[tuple[str, str]]:
    """(pattern, replacement) in turn, on the lower-cased text; patterns mean the same in Java and RE2."""
    steps = [(COPYRIGHT_LINE, " "), (r"[^a-z0-9]+", " ")]
    steps += [(rf"\b{a}\b", b) for a, b in SPELLINGS.items()]
    return steps + [(rf"^ ?(the )?({title}) {start}", start) for title, start in TITLES] + [(rf"{a} ?$", "") for a in _advice(steps)] + ADDRESSES


def canonical(text: Column) -> Column:
    """The canonical form; A-Z only are lower-cased, and other scripts count as punctuation."""
    out = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for pattern, to in canonical_steps():
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def known(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(digest, license_id): as many rows as licences are listed."""
    rows = [(k, v) for k, v in (KNOWN if texts is None else texts).items()]
    values = F.inline(F.array(*(F.struct(F.lit(k).alias("license_id"), F.lit(v).alias("text")) for k, v in rows)))
    form = canonical(F.col("text"))
    return spark.range(1).select(values).select("license_id", F.sha2(form, 256).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: dict[str, str] | None = None) -> DataFrame:
    """(id, digest, license_id) of every row; license_id is null where no known licence has the digest."""
    form = canonical(F.col(text_col))
    forms = docs.select(F.col(id_col), F.when(form != "", F.sha2(form, 256)).alias("digest"))
    return forms.join(F.broadcast(known(docs.sparkSession, texts)), "digest", "left").select(id_col, "digest", "license_id")
