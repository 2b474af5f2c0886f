"""H1, H12, H14-H17, H22-H26, H30-H33."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from souba import fixed_values as fv
from souba.functions import html as H, text


def test_half_width_keeps_katakana(evaluate):
    assert evaluate(["Ａｂ１２（～：　ア", "abc", None], text.to_half_width) == ["Ab12(~: ア", "abc", None]


def test_full_width_round_trip(evaluate):
    sample = "Core i5-8250U (1.6GHz) / 8GB　メモリ"
    assert evaluate([sample], lambda t: text.to_half_width(text.to_full_width(t))) == [sample.replace("　", " ")]


def test_strip_all_white_space(evaluate):
    assert evaluate(["　 a b\t\n", " x "], text.strip) == ["a b", "x"]


def test_clean_brand(evaluate):
    raw = ["DELL(デル)", "NEC", "シャープ(SHARP)", "その他メーカー", "株式会社富士通", "hp（エイチピー）"]
    assert evaluate(raw, text.clean_brand) == ["Dell", "NEC", "シャープ", "", "Fujitsu", "HP"]


def test_parse_price(evaluate):
    raw = ["¥12,345", "￥9,800（税込）", "販売価格 1,000円", "¥1,100～", "未定", "", None]
    assert evaluate(raw, text.parse_price) == [12345, 9800, 1000, 1100, None, None, None]
    strict = lambda t: text.parse_price(t, marks="¥,", strict=True)
    assert evaluate(raw, strict) == [12345, None, None, None, None, None, None]


def test_price_too_large_is_null(evaluate):
    assert evaluate(["9" * 30], text.parse_price) == [None]


def test_url_parts(evaluate):
    assert evaluate(["/a/b/c/", "/a/b%2Dd"], text.url_tail) == ["c", "b%2Dd"]
    assert evaluate(["/r/item?x=1&jan=200&y=2", "/r/item?x=1"], lambda u: text.url_parameter(u, "jan")) == ["200", None]
    assert evaluate(["/shopdetail/0012/ct/"], lambda u: text.url_number(u, "/shopdetail/", "/")) == ["0012"]
    assert evaluate(["/a", "https://b/c"], lambda u: text.absolute_url(u, "https://s")) == ["https://s/a", "https://b/c"]


def test_shop_name(evaluate):
    assert evaluate(["0799 （店頭販売有）", "A店"], text.shop_name) == ["0799", "A店"]


def test_conditions(evaluate):
    phrases = list(fv.CONDITION_GRADES) + [" 別の状態 ", " "]
    assert evaluate(phrases, text.condition_grade) == list(fv.CONDITION_GRADES.values()) + ["別の状態", None]
    titles = ["PC [B:良品] x", "PC [訳あり品]", "PC [バリュー品]", "PC"]
    assert evaluate(titles, text.condition_from_title) == ["B", "Junk", "Value", None]


def test_screen_size(evaluate):
    titles = ["PC 15.6インチ", "PC 13 INCH", "PC 12.1 i5", "TV 42.0 12.5", "PC 9.7インチ", "5GB"]
    assert evaluate(titles, text.screen_size) == [15.6, 13.0, 12.1, None, None, None]


def test_json_ld(spark):
    blocks = [["{bad", '{"@type": "Offer", "sku": "0"}', '{"@type": "Product", "sku": "A1"}', '{"@type": "Product", "sku": "B2"}'],
              ['{"@type": "Product"}'], [], None]
    df = spark.createDataFrame([(b,) for b in blocks], "b array<string>")
    assert [r[0] for r in df.select(text.json_ld_sku(F.col("b"))).collect()] == ["A1", "", None, None]


def test_first_with_word(spark):
    df = spark.createDataFrame([(["8GB", "Windows 11", "Linux"],), (["x"],), ([],)], "t array<string>")
    out = [r[0] for r in df.select(text.first_with_word(F.col("t"), fv.SPAN_OS_WORDS)).collect()]
    assert out == ["Windows 11", None, None]


def test_labels(spark):
    df = spark.createDataFrame([(12345, 1.25), (0, -3.04), (None, None), (999, 0.4)], "p bigint, c double")
    out = df.select(text.yen_or_dash(F.col("p")), text.change_class(F.col("c")), text.change_label(F.col("c"))).collect()
    assert [tuple(r) for r in out] == [
        ("¥12,345", "up", "↑ +1.3%  /7d"), ("—", "down", "↓ -3.0%  /7d"), ("—", "flat", "—"), ("¥999", "flat", "→ flat")]


def test_timestamp_is_an_instant(spark, evaluate):
    out = evaluate(["2026-02-21T08:30:00+09:00", "bad", None], lambda t: F.to_date(text.parse_timestamp(t)))
    assert out == [dt.date(2026, 2, 20), None, None]


def test_entities(evaluate):
    raw = ["a &amp;lt; b", "&#65;&#x3042;&yen;1", "plain", "&nbsp;x"]
    assert evaluate(raw, H.unescape) == ["a &lt; b", "Aあ¥1", "plain", " x"]


def test_html_helpers(evaluate):
    page = '<div class="a big"><p>x <b> y </b> z</p></div><div class="ab"><p>no</p></div><div class="a"></div>'
    over = lambda body: lambda h: text.let(H.tag_index(h), body)
    assert evaluate([page], over(lambda x: H.text_of(H.first(x, "p")))) == ["xyz"]
    assert evaluate([page], over(lambda x: F.size(H.cards_by_tag(x, "div", "a")))) == [2]
    assert evaluate([page], over(lambda x: H.text_of(H.first(x, "div", "missing")))) == [None]
    link = over(lambda x: H.attribute(H.attrs_of(H.first(x, "a")), "href"))
    assert evaluate(["<a href='/x?a=1&amp;b=2' data-k=v>", "<p>"], link) == ["/x?a=1&b=2", None]
    assert evaluate(["<a href='/x' data-k=v>"], over(lambda x: H.attribute(H.attrs_of(H.first(x, "a")), "data-k"))) == ["v"]


def test_tag_index(evaluate):
    over = lambda body: lambda h: text.let(H.tag_index(h), body)
    told = over(lambda x: H.raw_text_of(H.first(x, css_class="k")))
    nested = "<u class=\"j k\">1<u>2<u>3</u></u> < 4 <!-- <u class='k'>5</u> > --> 6 > 3></u>7"
    assert evaluate([nested, "<U CLASS='k'>a<br>b", "<u class='kk'>a</u>", "", None], told) == ["123 < 4  6 > 3>", "ab", None, None, None]
    assert evaluate([nested], over(H.comments)) == [[" <u class='k'>5</u> > "]]
    assert evaluate(["a<!-- b <p>c</p>"], over(lambda x: H.text_of(H.first(x, "p")))) == ["c"]       # an open comment is none
    scripts = "<p>a<script>'<p>'</script><!-- <script> --><style>p{}</style><b>&lt;i&gt;</b></p><p>b</p>"
    assert evaluate([scripts], over(lambda x: F.transform(H.every(x, "p"), H.text_of))) == [["a<i>", "b"]]
    deep = "<div class='k'>" + "<div>x" * 200 + "</div>" * 201 + "<div>out</div>"
    assert evaluate([deep], over(lambda x: F.size(H.first(x, "div", "k")))) == [401]
