"""Character references against the standard library's decoder."""

import html
import random
from html.entities import html5

from pyspark.sql import functions as F

from millrace.functions.html_text import unescape


def test_all_names_and_numbers_are_decoded(spark):
    rng = random.Random(1)
    names = sorted(html5)
    texts = [f"&{n}" for n in names] + [f"a&{n.rstrip(';')}z;" for n in names] + [f"&{n}=1" for n in names if not n.endswith(";")]
    texts += [f"&#{k};" for k in [*range(0, 700), 0xD7FF, 0xD800, 0xDFFF, 0xFDD0, 0xFFFD, 0xFFFE, 0x1F600, 0x10FFFD, 0x10FFFF, 0x110000, 10**9, 10**30]]
    texts += [f"&#x{k:x}" for k in range(0, 400)] + [f"&#X{k:04X}," for k in (0x80, 0x9F, 0x20AC, 0x1F600, 0x10FFFE)] + ["&#0000000000065;", "&#x0000000041;"]
    texts += ["", "&", "&;", "&#", "&#;", "&#x;", "&amp;lt;", "&amp;amp;lt;", "&nosuch;", "x && y &", "&notit; &notin;", "& amp;", "&" + "a" * 50 + ";", "&lt;b&gt;&nbsp;&quot;", "é&eacute;漢&#28450;"]
    bits = ["&amp;", "&lt", "&#39;", "&", ";", "x", " ", "&#x4e2d;", "&copy", "&hearts;", "\n", "&zz;"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", unescape(F.col("t")).alias("got")).collect()
    wrong = [(r.t, r.got, html.unescape(r.t)) for r in rows if r.t is not None and r.got != html.unescape(r.t)]
    assert wrong == []
    assert [r.got for r in rows if r.t is None] == [None]
