"""Cases that earlier versions got wrong."""

import pytest

from chronolex.llm import html_text, langid, media, repeats


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<body><div class="content no-sidebar"><article><p>One.</p></article></div></body>', "One."),
        ('<div class="layout with-sidebar"><main><p>One.</p></main><div class="sidebar">Side.</div></div>', "One."),
        ('<article class="post comments-open"><p>One.</p></article>', "One."),
        ('<form><article><p>One.</p><button>Go</button></article><div>Sign up</div></form>', "One."),
        ('<article><div class="ad-free"><p>One.</p></div><div class="ad">Buy.</div><div class="google-ad">Buy.</div></article>', "One."),
        ('<article><p>One.</p></article><div class="comments"><article class="comment">Mine.</article></div>', "One."),
        ('<article><p>One.</p></article><aside><article>Other story.</article></aside>', "One."),
        ('<article><p>One.</p><form><label>Mail</label> us <input></form></article>', "One."),
    ],
)
def test_names_that_only_hint_lose_no_article(html, want):
    found = html_text.lines(html)
    assert [t for (_, t), keep in zip(found, html_text.own_lines([m for m, _ in found]), strict=True) if keep] == [want]


def test_texts_without_a_letter_have_no_grams():
    for text in ("😀", "😀😀😀 123", "𝟙𝟚", "", " \n", "١٢"):
        assert langid.grams([text])[2].tolist() == [0], text
    assert langid.grams(["𐐀𐐁", "a😀b", "é"])[2].tolist() == [4, 2, 1]


def test_unclosed_caption_ends_with_its_figure():
    kinds = [(x["kind"], x["text"], x["caption"]) for x in media.sequence("<p>a</p><figure><img src=x><figcaption>cap</figure><p>later text</p>")]
    assert kinds == [("text", "a", None), ("image", None, "cap"), ("text", "later text", None)]
    assert [(x["kind"], x["text"], x["caption"]) for x in media.sequence("<figure><img src=x><figcaption><p>one</p><p>two</p></figcaption></figure>")] == [("image", None, "one two")]
    assert [x["text"] for x in media.sequence("<figcaption>alone")] == ["alone"]


def test_repeats_take_ids_of_any_type(spark):
    text = "abcdefghij" * 30
    docs = spark.createDataFrame([("x1", text), ("x2", text), (None, None)], "doc_id string, text string")
    rows = repeats.strip(docs).collect()
    assert sorted(sum(s["end"] - s["start"] for s in r["spans"]) for r in rows if r["n_bytes"]) == [290, 300]
