"""Byte-level operators against plain Python and the public library."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ferrolens.llm import bpe, columnbwt, decontamination, licenses, media, pages, toxicity
from ferrolens.llm.bytewords import INK_BYTE, WORD_BYTE, flat_bytes, prefix_hash, span_hash, words

TEXTS = ["", "One two, THREE", "été Ünder 中文 x", "a", " \t\n", "no-break space", "x" * 5000, "one two three one two three"]


@pytest.mark.parametrize(("member", "pattern"), [(WORD_BYTE, rb"[0-9a-z\x80-\xff]+"), (INK_BYTE, rb"[^\x20\x09-\x0d]+")])
def test_tokens_are_the_runs_of_each_text(member, pattern):
    h, owner, starts, ends, bounds = words(pa.array(TEXTS), member)
    want = [(i, m.span()) for i, t in enumerate(TEXTS) for m in re.finditer(pattern, t.encode().lower())]
    assert [(o, (s - bounds[o], e - bounds[o])) for o, s, e in zip(owner, starts, ends, strict=True)] == want
    by_text = {}
    for (i, (a, b)), x in zip(want, h.tolist(), strict=True):
        assert by_text.setdefault(TEXTS[i].encode().lower()[a:b], x) == x
    assert len(set(by_text.values())) == len(by_text)


def test_neighbouring_texts_do_not_join():
    h, owner, *_ = words(pa.array(["ab", "cd", "", "ef"]))
    assert owner.tolist() == [0, 1, 3] and len(set(h.tolist())) == 3


def test_bpe_equals_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.tokenizer_path()
    library, encoder = tokenizers.Tokenizer.from_file(path), bpe.Encoder(bpe.Vocabulary.read(path))
    rnd = random.Random(1)
    alphabet = "abcdefghijklmnopqrstuvwxyz'éü ß中あ0123!?-_.́​İΣ<|endoftext|>\x85\x1c "
    texts = TEXTS + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(800)] + ["<|endoftext|>a<|startoftext|>", "it's we're ''s", "z" * 200]
    ids, offsets = encoder.encode(texts)
    decoder = bpe.Decoder(encoder.v)
    for i, want in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        mine = ids[offsets[i] : offsets[i + 1]].tolist()
        assert mine == want.ids
        assert decoder.decode(mine) == library.decode(want.ids, skip_special_tokens=False)


def test_verification_finds_every_wrong_greedy_word():
    encoder = bpe.Encoder(bpe.Vocabulary.read(bpe.tokenizer_path()))
    rnd = random.Random(2)
    some = sorted({"".join(rnd.choice("thereationsdlyw") for _ in range(rnd.randint(1, 14))) for _ in range(3000)})
    flat, bounds = encoder.greedy(some)
    exact = [encoder.merged(w) for w in some]
    assert encoder.merged_all(some) == exact
    wrong = 0
    for i, want in enumerate(exact):
        mine = flat[bounds[i] : bounds[i + 1]]
        fine = encoder.compatible(mine[:-1], mine[1:]).all()
        assert fine == (mine.tolist() == want)
        wrong += not fine
    assert 0 < wrong < len(some)


def brute_suffixes(strings):
    rows = sorted((tuple(x + 1 for x in s[i:]) + (0, k), k, len(s) - i) for k, s in enumerate(strings) for i in range(len(s) + 1))
    out, before = [], None
    for t, k, n in rows:
        c = 0
        while before and c < min(len(before), len(t)) - 2 and before[c] == t[c]:
            c += 1
        out.append((k, n, c))
        before = t
    return out


@pytest.mark.parametrize("chunk", [3, 7, 1 << 20])
def test_column_wise_construction(chunk):
    rnd = random.Random(3)
    for trial in range(60):
        strings = [bytes(rnd.choice(b"ab\x00\xff" if trial % 2 else b"abcdefgh") for _ in range(rnd.randint(0, 12))) for _ in range(rnd.randint(1, 12))]
        made = columnbwt.build(np.frombuffer(b"".join(strings), np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in strings])]), chunk)
        assert list(zip(made.string.tolist(), made.length.tolist(), made.common.tolist(), strict=True)) == brute_suffixes(strings)


def test_fm_index_counts_and_locates():
    rnd = np.random.default_rng(5)
    text = np.concatenate([np.append(rnd.integers(1, 5, n), 0) for n in (40, 1, 300, 7, 300)])
    index = decontamination.FmIndex(text, 4)
    for n in (1, 2, 3, 6):
        phrases = np.unique(rnd.integers(1, 5, (50, n)), axis=0)
        lo, hi = index.search(phrases, np.full(len(phrases), n))
        for p, a, b in zip(phrases, lo, hi, strict=True):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def brute_hits(texts, items, window):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    phrases = {}
    for k, t in items:
        w = split(t)
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            phrases.setdefault(tuple(w[i : i + window]), set()).add(k)
    out = []
    for t in texts:
        w = split(t)
        hit, found = set(), set()
        for p, who in phrases.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    found |= who
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_decontamination_against_brute_force():
    rnd = random.Random(7)
    items = [("b", "One two THREE"), ("a", "one two three"), ("c", ""), ("d", None), ("10", " ".join(rnd.choice("uvw") for _ in range(20)))]
    texts = TEXTS + [" ".join(rnd.choice(["u", "v", "w", "one", "two", "three"]) for _ in range(rnd.randint(0, 80))) for _ in range(200)] + [items[-1][1]]
    phrases = decontamination.Phrases.of([(k, t or "") for k, t in items], 4)
    n_words, n_hit, found, spans = (c.to_pylist() for c in decontamination._columns(pa.array(texts), phrases))
    assert list(zip(n_words, n_hit, found, strict=True)) == brute_hits(texts, items, 4)
    for t, s in zip(texts, spans, strict=True):
        for x in s:
            assert len(re.findall(rb"[0-9a-z\x80-\xff]+", t.encode().lower()[x["byte_start"] : x["byte_end"]])) == x["end"] - x["start"]


def test_images_and_archives_round_trip(tmp_path):
    for payload in (b"", b"x", bytes(range(256)) * 3):
        image = media.png(media.pad(payload), str(len(payload)))
        assert media.unpng(image) == (payload + bytes(-len(payload) % 64 if payload else 64), str(len(payload)))
    with pytest.raises(ValueError, match="damaged"):
        media.unpng(image[:60] + b"?" + image[61:])


def test_license_alignment():
    index = licenses.Index.of(licenses.TEMPLATES)
    text = "Intro words here. Released under the MIT License. Then THIS work is licensed under the GNU Lesser General Public License, version 3. The end."
    counts, found = licenses.scan(pa.array([text, "", "nothing of the kind"]), index, 0.8)
    got = {m["license"]: m for m in found[0]}
    assert set(got) == {"mit-notice", "gpl-notice"} and found[1:] == [[], []]
    assert got["mit-notice"]["coverage"] == 1.0 and text[got["mit-notice"]["byte_start"] : got["mit-notice"]["byte_end"]] == "Released under the MIT License"
    assert got["gpl-notice"]["coverage"] == 1.0
    assert text[got["gpl-notice"]["byte_start"] : got["gpl-notice"]["byte_end"]] == "THIS work is licensed under the GNU Lesser General Public License, version 3"


@pytest.mark.parametrize("between", [" Foo. ", " ", " Foo bar baz. "])
@pytest.mark.parametrize("notice", ["All rights reserved.", "Released under the MIT License."])
def test_adjacent_notices_all_match(notice, between):
    index = licenses.Index.of(licenses.TEMPLATES)
    for n in (2, 3, 50):
        text = between.join([notice] * n)
        _, found = licenses.scan(pa.array([text]), index, 0.8)
        assert [text[m["byte_start"] : m["byte_end"]] for m in found[0]] == [notice[:-1]] * n


def test_page_text():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li>Menu</ul></nav>"
        "<div class='ad'>Buy</div><article><header><h1>Head &amp; tail</h1><p>by x</p></header><p><b>One<br>two<p>Three &lt;3&nbsp;x</p><aside>Side</aside>"
        "<section id=comments><p>Nice</p></section><ul><li>a<li>b</ul></article><footer>&copy;</footer>"
    )
    assert pages.Page(page).text({})[0] == "Head & tail\n\nOne two\n\nThree <3 x\n\na\n\nb"
    assert pages.Page("").text({})[0] == "" == pages.Page("<p").text({})[0]
    plain = "<body><div>Site name</div><p>Body text</p></body>"
    parsed = pages.Page(plain)
    template = {parsed.hashes()[parsed.tags.index("div")]: 1.0}
    assert parsed.text({}) == ("Site name\n\nBody text", 0, 0)
    assert parsed.text(template) == ("Body text", 1, 0)


def test_articles_stay_whatever_their_theme_says():
    text = lambda page: pages.Page(page).text({})[0]
    for attributes in ('style="overflow:hidden"', 'data-id="ad" data-role="form"', 'class="content has-sidebar"', 'class="post no-comments"', 'class="layout with-nav"', 'title="no hidden class=ad"'):
        assert text(f"<body><div {attributes}><p>Kept</p></div></body>") == "Kept"
        assert text(f"<body><div {attributes}><article {attributes}><p>Kept</p></article></div></body>") == "Kept"
    assert text("<body><div class='sidebar-left wide'><article class='widget notice'><p>Kept</p></article></div></body>") == "Kept"
    for attributes in ("hidden", "class='box ad-banner'", "id=comments", "class='post-comments'", "role=navigation"):
        assert text(f"<body><p>Kept</p><div {attributes}><p>Gone</p></div></body>") == "Kept"
    assert text("<body><article><p>Kept</p></article><div id=comments><article><p>Reply</p></article></div></body>") == "Kept"
    assert text("<body><article class=comments><p>Kept</p></article></body>") == "Kept"
    for attributes in ("class='social-history'", "id='share-price'", "class='comment-on-law'"):
        assert text(f"<article><p>Intro</p><section {attributes}><p>Kept</p></section></article>") == "Intro\n\nKept"
    for attributes in ("class='site-footer'", "class='share-buttons'", "id='newsletter-signup'", "class='cookie-notice bottom'"):
        assert text(f"<article><p>Intro</p><div {attributes}><p>Gone</p></div></article>") == "Intro"


def test_template_within_articles():
    subscribe, passage = "<div>Subscribe to our list today</div>", "<p>" + "A passage that the site quotes again and again. " * 6 + "</p>"
    byline, menu = "<p>By our staff</p>", "<div class='top'><a href='/{0}'>Go {0}</a> <a href='/b'>There</a></div>"
    site = [f"<body>{menu.format(i)}<article><h1>Title {i}</h1>{byline}<p>Text {i}</p>{passage if i < 5 else ''}{subscribe}</article></body>" for i in range(8)]
    again = "<body><article><p>The same notice</p></article></body>"
    whole = [*site, *[again] * 8]
    counts = collections.Counter(h for p in whole for h in set(pages.Page(p).hashes().values()))
    common = {h: n / 16 for h, n in counts.items() if n >= 4 and n >= 1.6}
    said = "A passage that the site quotes again and again. " * 6
    for i, p in enumerate(site):
        text, by_template, by_rule = pages.Page(p).text(common)
        assert text == "\n\n".join([f"Title {i}", f"Text {i}", *([said.strip()] if i < 5 else [])])
        assert (by_template, by_rule) == (3, 0)  # menu, byline and subscription
        assert "Subscribe" in pages.Page(p).text({})[0]
    assert pages.Page(again).text(common)[0] == "The same notice"  # nothing else would be left


def test_deobfuscation():
    rnd = random.Random(11)
    lexicon = "stupid idiot moron worthless the quick brown fox jumps over lazy dog and then runs away from it".split()
    counts = np.zeros(toxicity.CLASSES**toxicity.ORDER, np.int64)
    for _ in range(400):
        line = np.concatenate([[0, 0, 0], toxicity.CLASS[np.frombuffer(" ".join(rnd.choices(lexicon, k=12)).encode(), np.uint8)], [0]])
        key = ((line[:-3] * 30 + line[1:-2]) * 30 + line[2:-1]) * 30 + line[3:]
        np.add.at(counts, key, 1)
    restore = toxicity.Restorer(toxicity.character_model(counts)).texts
    given = ["you 1d10t", "s t u p i d fox", "m.o.r.o.n!", "stuuuupid", "", "the quick fox", "w0rthle55"]
    assert restore(pa.array(given)).to_pylist() == ["you idiot", "stupid fox", "moron!", "stupid", "", "the quick fox", "worthless"]


def test_combined_disguises():
    rnd = random.Random(11)
    lexicon = "stupid idiot moron worthless the quick brown fox jumps over lazy dog and then runs away from it".split()
    counts = np.zeros(toxicity.CLASSES**toxicity.ORDER, np.int64)
    for _ in range(400):
        line = np.concatenate([[0, 0, 0], toxicity.CLASS[np.frombuffer(" ".join(rnd.choices(lexicon, k=12)).encode(), np.uint8)], [0]])
        key = ((line[:-3] * 30 + line[1:-2]) * 30 + line[2:-1]) * 30 + line[3:]
        np.add.at(counts, key, 1)
    restore = toxicity.Restorer(toxicity.character_model(counts)).texts
    given = ["you m 0 r 0 n", "1 d 1 o t", "m.0.r.0.n", "an 1 d ! o t runs", "1 2 3", "the fox 4 5 6", "10.0.0.1"]
    assert restore(pa.array(given)).to_pylist() == ["you moron", "idiot", "moron", "an idiot runs", "1 2 3", "the fox 4 5 6", "10.0.0.1"]


def test_hashes_depend_on_content_alone():
    data, _ = flat_bytes(pa.array(["abcabc", "abc"]))
    p = prefix_hash(data)
    a, b, c, d = span_hash(p, np.array([0, 3, 6, 0]), np.array([3, 6, 9, 4])).tolist()
    assert a == b == c != d
