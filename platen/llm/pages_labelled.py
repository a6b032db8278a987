"""Labelled pages for the extractor: layouts whose main blocks carry the attribute ``data-main``.

The layouts are written by hand; a rule fills them with words, with the names that sites give to what
surrounds an article, and with more or fewer paragraphs. The extractor never sees ``data-main`` as a feature.
"""

from __future__ import annotations

import random

#: Names of classes, ids and roles by what they mark. Fixed values.
AROUND = {
    "nav": "nav navbar navigation menu menubar topbar breadcrumb breadcrumbs pagination pager links toc tabs",
    "head": "header masthead branding logo sitename tagline top hero",
    "foot": "footer foot bottom copyright legal colophon credits sitemap contentinfo",
    "side": "sidebar side aside widget widgets related recommended popular trending more teaser tags archive complementary",
    "note": "notice cookie cookies consent gdpr banner alert popup modal overlay newsletter subscribe signup paywall",
    "ad": "ad ads advert advertisement adbox sponsor sponsored promo promotion commercial dfp",
    "form": "form search login register contact",
    "talk": "comments comment commentlist discussion replies reply respond disqus thread responses feedback",
    "share": "share social sharing follow",
}
MAIN = "content article post entry story text body main page single prose maincontent"

_WORDS = "the of and to in is it that for on with as was be by are this not from at die der und das ist le la les des et une que para con los las del son no river market evening report council winter machine garden letter doctor street village music"


def _filled(rng: random.Random) -> str:
    word = lambda: rng.choice(_WORDS.split())
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + rng.choice([".", ".", ".", "!", "?", ",", ""])
    long = lambda: " ".join(sentence(rng.randint(3, 16)) for _ in range(rng.randint(1, 6)))
    short = lambda: sentence(rng.randint(1, 4))
    name = lambda kind: rng.choice(AROUND[kind].split())
    attr = lambda kind: rng.choice(["class", "id"]) + f'="{name(kind)}{rng.choice(["", "-box", " wide", "_1"])}"'
    links = lambda n: "".join(f'<li><a href="/{word()}">{short()}</a></li>' for _ in range(n))
    some = lambda *parts: "".join(p() for p in parts if rng.random() < 0.6)

    def main_block() -> str:
        kind = rng.random()
        text = short() if rng.random() < 0.3 else long()
        if kind < 0.7:
            return f"<p data-main>{rng.choice(['', '<b>', '<em>'])}{text}{rng.choice(['', '<br>', '</b>', ' <a href=x>' + word() + '</a> ' + word()])}</p>"
        if kind < 0.8:
            return f"<h{rng.randint(2, 4)} data-main>{short()}</h2>"
        if kind < 0.87:
            return "<ul>" + "".join(f"<li data-main>{short()}</li>" for _ in range(rng.randint(2, 4))) + "</ul>"
        return rng.choice([f"<blockquote data-main>{text}</blockquote>", f"<pre data-main>{text}</pre>", f"<div data-main>{text}</div>", f"<table><tr><td data-main>{short()}</td><td data-main>{short()}</td></tr></table>"])

    blocks = lambda most=12: "".join(main_block() + (rng.choice([ad, ad, side, note, note, note, form, share, nav])() if rng.random() < 0.2 else "") for _ in range(rng.randint(1, most)))
    ad = lambda: f"<div {attr('ad')}>{rng.choice([short, long])()}</div>"
    note = lambda: rng.choice([f"<{rng.choice(['div', 'section', 'p', 'dialog'])} {attr('note')}>{rng.choice([short, long])()}<button>OK</button></div></dialog>", f"<p {attr('note')}>{rng.choice([short, long])()}</p>", f"<dialog open>{rng.choice(['<p>', ''])}{rng.choice([short, long])()}</dialog>"])
    nav = lambda: rng.choice([f"<nav><ul>{links(rng.randint(2, 7))}</ul></nav>", f"<div {attr('nav')}><ul>{links(4)}</ul></div>", f"<div {attr('nav')}><a href=/>{short()}</a> | <a href=/x>{short()}</a></div>"])
    head = lambda: rng.choice([f"<header><h1>{short()}</h1><p>{short()}</p></header>", f"<div {attr('head')}><h2>{short()}</h2>{short()}</div>"])
    foot = lambda: rng.choice([f"<footer>&copy; {word()}.example.com &middot; {rng.choice([short, long])()}</footer>", f"<footer><p>{long()}</p><ul>{links(2)}</ul></footer>", f"<div {attr('foot')}><p>&copy; 2020 {short()}</p><ul>{links(2)}</ul></div>"])
    side = lambda: rng.choice([f"<aside><h3>{short()}</h3><ul>{links(4)}</ul><p>{long()}</p></aside>", f"<aside>{rng.choice([short, long])()}</aside>", f"<div {attr('side')}><h3>{short()}</h3><p>{long()}</p></div>", f"<div {attr('side')}>{long()}</div>"])
    form = lambda: rng.choice([f"<form {attr('form')}><label>{short()}</label><input><p>{short()}</p><button>{word()}</button></form>", f"<form><p>{long()}</p></form>", f"<form>{short()}<select><option>{word()}<option>{word()}</select></form>"])
    remark = lambda: rng.choice([f"<div class={name('talk')}><p>{rng.choice([short, long])()}</p></div>", f"<p>{rng.choice([short, long])()}</p>", f"<article><h4>{short()}</h4><p>{long()}</p></article>", f"<article><p>{rng.choice([short, long])()}</p></article>", f"<ul><li>{rng.choice([short, long])()}</li><li>{long()}</li></ul>", f"<li>{rng.choice([short, long])()}</li>"])
    talk = lambda: f"<{rng.choice(['div', 'section', 'ol'])} {attr('talk')}><h3>{short()}</h3>" + "".join(remark() for _ in range(rng.randint(1, 5))) + "</div>"
    share = lambda: f"<div {attr('share')}>{short()} <a href=x>{word()}</a></div>"
    title = lambda: rng.choice([f"<h1 data-main>{short()}</h1>"] * 4 + [f"<header><h1 data-main>{short()}</h1></header>", ""])
    tail = lambda: "".join(rng.choice([share, talk, talk, side, ad, form])() for _ in range(rng.choice([0, 0, 1, 2])))
    inner = lambda: title() + some(share) + blocks() + tail() + (blocks(3) if rng.random() < 0.15 else "")
    mains = rng.choice(MAIN.split())
    layout = rng.choice([
        lambda: f"<article>{inner()}</article>",
        lambda: f"<article>{inner()}</article>",
        lambda: f"<main><article>{inner()}</article></main>",
        lambda: f"<main>{inner()}</main>",
        lambda: f'<div class="{mains}">{inner()}</div>',
        lambda: f'<div id="{mains}"><div class="{rng.choice(MAIN.split())}">{inner()}</div></div>',
        lambda: f"<table><tr><td {attr('side')}>{long()}</td><td>{inner()}</td></tr></table>",
        lambda: f"<div>{title()}{blocks()}</div>",
        lambda: f"<section>{title()}{blocks()}</section>{talk()}",
        lambda: f"{title()}{blocks()}",
        lambda: f'<div class="{mains}"><div {attr("side")}><h3>{short()}</h3><p>{long()}</p></div><div>{inner()}</div></div>',
    ])()
    before, after = [nav, head, note, ad, form, side], [side, talk, form, ad, note, share]
    rng.shuffle(before)
    rng.shuffle(after)
    page = f"{some(*before)}{layout}{some(*after)}{foot() if rng.random() < 0.9 else ''}"
    if rng.random() < 0.15:  # nothing before the article, or nothing around it at all
        page = layout + rng.choice(["", talk(), foot(), note()])
    around = rng.random()  # what holds the whole page is no guide to what an article is
    if around < 0.06:
        page = f'<form id="{word()}">{page}</form>'
    elif around < 0.14:
        page = f'<div class="{name(rng.choice(["side", "nav", "head"]))}-{rng.choice(["layout", "wrap", "left"])}">{page}</div>'
    elif around < 0.24:
        page = f'<div class="{rng.choice(MAIN.split())}-wrap">{page}</div>'
    return f"<html><head><title>{short()}</title><style>p{{}}</style></head><body>{page}</body></html>"


def labelled_pages(n: int = 700, seed: int = 11) -> list[str]:
    rng = random.Random(seed)
    return [_filled(rng) for _ in range(n)]
