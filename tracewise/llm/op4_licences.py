"""License scans: canonical digest lookup.

A text is brought to a canonical form (case, punctuation, copyright lines,
equivalent spellings, white space), digested, and the digest is hash-joined to
the digests of known licence texts brought to the same form.  Looked up are
the whole document and each of its lines, so a one-line notice at the end of a
document is found too.  Only DataFrame functions are used.

A whole text is looked up twice: in its canonical form, and with copyright lines
behind comment marks or with a name to fill in left out as well.  ``SQL`` knows the
first form and ``NOTICES`` only; ``text_digest`` is that of the first form.

The catalogue is a fixed, small table, so it may be broadcast; the lines that
reach the join are those whose canonical length is that of a known text.

Defined results: a null text is empty and matches nothing; repeated rows are
scanned one by one; other columns are dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: public licence notices and texts ------------------------
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files (the \"Software\"), to deal in the Software without "
            "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
            "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
            "to do so, subject to the following conditions:\nThe above copyright notice and this permission notice "
            "shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED "
            "\"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
            "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
            "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
            "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
            "USE OR OTHER DEALINGS IN THE SOFTWARE."),
]
#: Whole texts as (licence, canonical length, digest): texts of the GNU licences, Apache, MPL and CC0, and MIT,
#: ISC and BSD texts with and without the usual title lines, without copyright lines (``_MARKED``).
TEXTS = [
    ("Apache-2.0", 8843, "6aa661403864282a4d084f1551e8149a5f1a7b5e8b05b6db8e1a8a28d0badc64"),
    ("Apache-2.0", 8863, "e7c5260ee7e187aa32deaf9fe84733b5dbe1dd1f3c36f232c49799c716b73570"),
    ("Apache-2.0", 8871, "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe"),
    ("Apache-2.0", 9887, "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b"),
    ("Apache-2.0", 9889, "45c5565dedc03ff2a570c67c5af611f8a3d0a0227c6e81d9fb11fbf0c004b959"),
    ("Apache-2.0", 9901, "7c15fde9438f81f4fb322ce23d53a5a5cb95d7fe7553460bb6df26d764bc88c2"),
    ("BSD-2-Clause", 1173, "032f33a9fad178d38ba062bc5f6e47fde5eb48f13d4c8895fe1360e806c83a69"),
    ("BSD-2-Clause", 1185, "85b4e5f84a49be2c956e295ef3eb7be6d41833526b71640c432e94bc4157f8b7"),
    ("BSD-2-Clause", 1189, "6cc862c1f361bc6eecca63caf3b4ec6670825d4917e73700c8557ea444b19e48"),
    ("BSD-2-Clause", 1192, "7be8178e4e9d0dea6ff4b04bd52bd086d7ea8386a5a6e09760df916bae5d42d2"),
    ("BSD-2-Clause", 1193, "986c3c3199a93b916c8f2e0aeed57819bcbdcb2cd9d99902dcc9d74b53f93a74"),
    ("BSD-2-Clause", 1194, "eddcfdfb771f61c172f95c7ecd254d9c71d0a17a25bd31d82a815e6dfed10825"),
    ("BSD-2-Clause", 1196, "8834af0c73ed33b37877c9802e794cc5ada000b26e9d35a3bc44759cb74087a7"),
    ("BSD-2-Clause", 1197, "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30"),
    ("BSD-2-Clause", 1198, "4383e33424fc6aa46640f80aec019015d6f40e9da46cef735cb4c8a917c63da1"),
    ("BSD-2-Clause", 1204, "a22a1b1fd2de7816d322e7e5704778af52b1861158deb8a3cc441af54046dc0f"),
    ("BSD-2-Clause", 1205, "e74f02edf06350e22d771b60d0580c53e28783fd12eda06abd03dab1348bc9d9"),
    ("BSD-2-Clause", 1208, "6e7a812c94c21565e57090a9d12200f36dbcf7537bf22ee860a7c3bc8a112122"),
    ("BSD-2-Clause", 1209, "39a218d326b053017477f11ba35cee9d26fdac59f5656824e14e35aad6ac5ace"),
    ("BSD-2-Clause", 1209, "bc1e385eb5d19c6613b84fb0a516cbaef80caefb192cf62a0c520c07f0fcab07"),
    ("BSD-2-Clause", 1213, "2745cc0a63b844cf79449cfeb9dbecb681f38d964a1341225821c2b2e836d0d0"),
    ("BSD-2-Clause", 1213, "6a5d49c15e02e9e94957d78177d86e8631be9a19549a7cfd2e8c3be2699f00b9"),
    ("BSD-2-Clause", 1214, "23d7258e25bd67982ccec4b5bfc05631a20f8ee5bd5fe7eb70694c100aae88d2"),
    ("BSD-2-Clause", 1215, "b070fd5d70d88d2dc201bf62e27cd5c1a36261a7b51912e5e4f044a2081fc2be"),
    ("BSD-2-Clause", 1216, "dfb735646da984cb814b2aab18aef097d6e575950073bd82353f618e44014642"),
    ("BSD-2-Clause", 1217, "117fa84a7ffb2cb3a2ba7d18dd284e7283b034d6fb6c6419721ee4e28b5306fe"),
    ("BSD-2-Clause", 1218, "447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2"),
    ("BSD-2-Clause", 1218, "e90608a663ae638023eb95a6ae359f7b6b865e6237fa832c48500c4e1af035b9"),
    ("BSD-2-Clause", 1220, "b265945940ccdc41492a8c56728fe75bfaf767b67d176e33b2649c7dcf426893"),
    ("BSD-2-Clause", 1222, "f9c0de945db946a0b06e8587a80b1b35b3f3e48a0f63cb64860eb4e433d32c7b"),
    ("BSD-3-Clause", 1361, "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("BSD-3-Clause", 1373, "6cd2ec4c1707d264427cffd6a4120fb4ce726f221152e3e5c63f8b57d2e1693e"),
    ("BSD-3-Clause", 1377, "6dd35bce98db3fa45a370b235b582cdcb2284ef2507066048a386c572223f19a"),
    ("BSD-3-Clause", 1377, "72b1a06b1bd5bde36392094bf4e5144c7a25fe215c30d421928fae268dec4a73"),
    ("BSD-3-Clause", 1380, "53075742228962c7ea381b8242c64602fa32e7b8f52facb6d13ee4f9c596ddfa"),
    ("BSD-3-Clause", 1382, "69fcedb70fd1930cb5d773bb71eb605a3aec6362c678302194666d60ca468f71"),
    ("BSD-3-Clause", 1386, "1b9c2fc92ea32d1c705d689163d6e1783efd910af0262514c4185cad11fefe75"),
    ("BSD-3-Clause", 1386, "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2"),
    ("BSD-3-Clause", 1392, "5a6e7ec0b1ac1e224277a8a6d5cd7691ea38298b0308b87a7a2e539d020ed1e0"),
    ("BSD-3-Clause", 1396, "6f922c6cb2a22faa1c3d9be59103bf5dc2942321f1c76cc3b6f0772aa184826c"),
    ("BSD-3-Clause", 1396, "afc81ee99a150bf9ad976d1b4b3bae3ec8fb30e82c7f9ec18d0048b070d2ebc8"),
    ("BSD-3-Clause", 1398, "214aa9c28152d6d77e6bebfb4a7511e677f65fdaf94b0fe9c0bb580e0eaf8997"),
    ("BSD-3-Clause", 1401, "f94931e221f919e6cec5ca99e0ea7da1912b2c7d805cdaee8baf508c248bc1af"),
    ("BSD-3-Clause", 1402, "ceb36b0173297578925e297a5e163a7f0f988327f28c8eb9654153d4354b2598"),
    ("BSD-3-Clause", 1402, "d1ecc0a46c23dad7f9e13b19b877e5be7ec9d2b9bb05a2dfde2e47be83438590"),
    ("BSD-3-Clause", 1405, "326c317935b3409d9750fd4ad5326ce15c9b75d313b4baf2cb9ff54accf8d903"),
    ("BSD-3-Clause", 1407, "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15"),
    ("BSD-3-Clause", 1411, "73a15ef51d0f74bce7fc4d1287b8d8a639c37581de7f63863957aea115dca7da"),
    ("CC0-1.0", 6692, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GPL-1.0", 11765, "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", 17117, "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", 33409, "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("ISC", 679, "217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a"),
    ("ISC", 691, "f172f90a892d869d5d840d5f4363218a9b21bdb1bd3925ba9c752d1660134fee"),
    ("ISC", 695, "23651ce8a73abaa8fad9143faad3fca843b5de6baf345008f65c453ea5685fb1"),
    ("ISC", 695, "40e6eb51c3b409d93549806b55b249c261dab149d19b56cc163624f39a08b1db"),
    ("ISC", 699, "5456fff23cf44064ff54d9d973cf8a7204e2788759d3d01ba3de38afc4515eee"),
    ("LGPL-2.0", 24130, "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", 25217, "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", 7104, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MIT", 988, "0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c"),
    ("MIT", 1000, "35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164"),
    ("MIT", 1004, "6ad3654379e72bbdf8478d5c90fb1e2525aba033fbe675e0ef2248aac67c0f6f"),
    ("MIT", 1004, "7c3366b22b9f0d6a198b2c29bd1c4b663b2d55eacbd066146e5476c4b8ff1ce4"),
    ("MIT", 1008, "6c833965e9ca4cf8095655005226f24fe8bf7b1605dbe513204837a7371fa127"),
    ("MPL-1.1", 22448, "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"),
    ("MPL-2.0", 14341, "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
]
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"),
             ("organisation", "organization"), ("authorised", "authorized"), ("favour", "favor"),
             ("non commercial", "noncommercial"), ("per cent", "percent"), ("copyright owner", "copyright holder"),
             ("v2", "version 2"), ("v3", "version 3")]
# ----------------------------------------------------------------------------
_COPYRIGHT = r"(?m)^[ \t]*(?:copyright[ \t]*(?:\(c\)|©|[0-9])|\(c\)[ \t]*[0-9]|©|all rights reserved)[^\n]*$"
#: The same behind comment marks, and with a name to fill in.
_MARKED = r"(?m)^[^a-z0-9\n(©]*(?:copyright[ \t]*(?:\(c\)|©|[0-9\[<{])|\(c\)[ \t]*[0-9]|©|all rights reserved)[^\n]*$"
_JOINERS = r"[^a-z0-9\n\x{80}-\x{10FFFF}]+"


def canonical_lines(text: Column, left_out: str = _COPYRIGHT) -> Column:
    """The canonical form of each line of a text, as an array; lines left empty are dropped."""
    t = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    t = F.regexp_replace(t, left_out, "")
    t = F.regexp_replace(t, _JOINERS, " ")
    # words stand between blanks by now; few texts hold one with another spelling
    respelt = reduce(lambda x, p: F.regexp_replace(x, f"(?<![^ \n]){p[0]}(?![^ \n])", p[1]), SPELLINGS, t)
    t = F.when(t.rlike("|".join(p[0] for p in SPELLINGS)), respelt).otherwise(t)
    return F.filter(F.transform(F.split(t, "\n"), lambda line: F.trim(line)), lambda line: line != "")


def canonical(text: Column) -> Column:
    """The canonical form of a text: its canonical lines joined by blanks."""
    return F.array_join(canonical_lines(text), " ")


def catalogue(spark: SparkSession, notices: list[tuple[str, str]] = NOTICES,
              texts: list[tuple[str, int, str]] = TEXTS) -> DataFrame:
    """Known digests: license, k_digest, k_len (canonical length)."""
    rows = spark.createDataFrame(notices, "license string, notice string")
    form = canonical(F.col("notice"))
    whole = spark.createDataFrame(texts, "license string, k_len int, k_digest string")
    every = rows.select("license", F.length(form).alias("k_len"), F.sha2(form, 256).alias("k_digest")).unionByName(whole)
    return every.groupBy("k_digest").agg(F.min("license").alias("license"), F.max("k_len").alias("k_len"))


def scan(docs: DataFrame, known: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, text_digest (of the canonical whole text), license
    (of the whole text, null if unknown), n_notices (lines that are known texts) and
    line_licenses (their licences, distinct, sorted, comma-joined)."""
    known = catalogue(docs.sparkSession) if known is None else known
    lengths = sorted(r[0] for r in known.select("k_len").distinct().collect())
    lines = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), canonical_lines(F.col(text)).alias("lines"),
        F.when(F.col(text).rlike("(?i)" + _MARKED), canonical_lines(F.col(text), _MARKED)).alias("bare"))
    form = lambda part, t: F.struct(F.sha2(t, 256).alias("digest"), F.lit(part).alias("part"))
    # a row for each form of the whole text, then one for each line as long as a known text
    unit = lines.select("row", "doc_id", F.explode(F.concat(
        F.filter(F.array(form("whole", F.array_join("lines", " ")), form("bare", F.array_join("bare", " "))),
                 lambda u: u["digest"].isNotNull()),
        F.transform(F.filter("lines", lambda x: F.length(x).isin(*lengths)) if lengths else F.filter("lines", lambda x: F.lit(False)),
                    lambda x: form("line", x)))).alias("u"))
    hit = (unit.select("row", "doc_id", "u.digest", "u.part")
           .join(F.broadcast(known.select("k_digest", "license")), F.col("digest") == F.col("k_digest"), "left")
           .where("part = 'whole' or license is not null"))
    of = lambda part, name: F.when(F.col("part") == part, F.col(name))
    return hit.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max(of("whole", "digest")).alias("text_digest"),
        F.coalesce(F.max(of("whole", "license")), F.max(of("bare", "license"))).alias("license"),
        F.count(of("line", "digest")).alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set(of("line", "license"))), ",").alias("line_licenses"),
    ).drop("row")


def _sql_form(text: str) -> str:
    """The canonical lines of a text in DuckDB's SQL (RE2 has no look-around: replace twice)."""
    t = (f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    t = f"regexp_replace({t}, '{_COPYRIGHT}', '', 'g')"
    t = f"regexp_replace({t}, '{_JOINERS}', ' ', 'g')"
    for a, b in SPELLINGS:
        for _ in range(2):
            t = f"regexp_replace({t}, '(^|[ \n]){a}($|[ \n])', '\1{b}\2', 'g')"
    return f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


SQL = f"""
WITH notices(license, notice) AS (VALUES {", ".join("('" + a + "', '" + b.replace("'", "''") + "')" for a, b in NOTICES)}),
known AS (SELECT digest, min(license) AS license FROM (
  SELECT license, sha256(array_to_string({_sql_form("notice")}, ' ')) AS digest FROM notices) GROUP BY digest),
doc AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_sql_form("text")} AS lines FROM documents),
line AS (SELECT r, sha256(l) AS digest FROM (SELECT r, unnest(lines) AS l FROM doc)),
hit AS (SELECT r, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names
        FROM line JOIN known USING (digest) GROUP BY r),
whole AS (SELECT r, doc_id, sha256(array_to_string(lines, ' ')) AS text_digest FROM doc)
SELECT doc_id, text_digest, known.license, coalesce(n, 0) AS n_notices, coalesce(names, '') AS line_licenses
FROM whole LEFT JOIN hit USING (r) LEFT JOIN known ON known.digest = whole.text_digest
"""
