"""Hand-written page layouts in plain English, for the block labeller: nothing here comes from its training pages."""

import itertools

TITLES = ["How the old harbour was rebuilt", "A short guide to growing tomatoes", "Why bridges sway in the wind", "The village that moved uphill", "Notes on repairing a bicycle"]
PARAGRAPHS = [
    "The harbour had stood empty for almost thirty years when the first engineers came to look at its walls, and nobody in the town expected much of their visit.",
    "They found that most of the stone could be used again, provided that it was taken out piece by piece and numbered before the winter storms arrived.",
    "Work began in April.",
    "Tomatoes need sun, water and patience, in that order. Plant them once the nights are warm, and tie every stem loosely to a stick so that the wind can't break it.",
    "Some gardeners remove the side shoots; others let them grow. Both ways give fruit, although the first one gives fewer and larger ones.",
    "A bridge is never quite still. Even on a calm day its deck rises and falls by a few millimetres as cars pass, and engineers plan for movement that is far larger than that.",
    "When the river rose for the third time in ten years, the council asked every family whether it would rather build higher walls or leave the valley altogether.",
    "Most of them chose to leave, but they wanted to go together.",
    "Before you take the wheel off, shift to the smallest gear and open the brake. The chain will then come away without any force, and you can lift the frame with one hand.",
    "In the end the whole repair took less than an hour, and it cost no more than a new tube and a little grease.",
]
MENUS = [["Home", "News", "About", "Contact"], ["Start", "Products", "Shop", "Support", "Log in"], ["Archive", "Authors", "Topics"]]
NAMES = [("prose", "wrapper", "row"), ("c-1", "c-2", "c-3"), ("page", "single", "container"), ("col-md-8", "row", "grid"), ("primary", "outer", "inner"), ("x7f3a", "b91", "k0"), ("", "", ""), ("post-body", "site", "layout"), ("css-1q2w3e", "css-9z8y7x", "css-abc123"), ("elementor-12", "section-wrap", "flex"), ("mw-parser-output", "mw-body", "vector-body"), ("left", "middle", "page-wrap"), ("td-ss-main", "td-container", "td-pb-row"), ("zone", "region", "block"), ("hentry", "hfeed", "group")]


def article(k):
    """(html, blocks) of the k-th article: title and paragraphs, a list, a quotation or a subheading among them."""
    said = [PARAGRAPHS[(k + i) % len(PARAGRAPHS)] for i in range(2 + k % 5)]
    parts = [("h1", TITLES[k % len(TITLES)]), *[("p", s) for s in said]]
    if k % 3 == 1:
        parts.insert(2, ("h2", "What happened next"))
    if k % 4 == 2:
        parts.append(("blockquote", "Nobody believed that it would hold, the foreman said later."))
    text = [s for _, s in parts]
    made = [f"<{t}>{s}</{t}>" for t, s in parts]
    if k % 5 == 3:
        items = ["Two buckets of clean water", "A soft brush", "Plenty of time"]
        made.append("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>")
        text += items
    return made, text


def div(name, inner):
    return f'<div class="{name}">{inner}</div>' if name else f"<div>{inner}</div>"


def pages():
    """(html, article blocks, all other blocks' texts) of each page."""
    for k, (names, layout) in enumerate(itertools.product(NAMES, range(14))):
        made, said = article(k)
        a, b, c = names
        body = "".join(made)
        links = "".join(f'<li><a href="/{i}">{m}</a></li>' for i, m in enumerate(MENUS[k % 3]))
        menu, foot = f"<nav><ul>{links}</ul></nav>", "<footer><p>&copy; 2024 Harbour Press. All rights reserved.</p></footer>"
        plain_menu = f"<ul>{links}</ul>"
        related = "<aside><h3>Related</h3><ul><li><a href=/a>Ten walks by the sea</a></li><li><a href=/b>What the ferry saw</a></li></ul></aside>"
        if layout == 0:
            page = f"<body>{menu}{div(a, body)}{foot}</body>"
        elif layout == 1:
            page = f"<body>{div(c, div(b, menu + div(a, body) + foot))}</body>"
        elif layout == 2:
            page = f"<body>{menu}{div(c, div(b, div(a, body)) + related)}{foot}</body>"
        elif layout == 3:
            page = f"<body>{div(b, plain_menu)}{div(c, div(b, div(b, div(a, body))))}<div class='footer'>&copy; 2024 Harbour Press</div></body>"
        elif layout == 4:
            page = f"<body>{menu}<main>{div(a, body)}</main>{related}{foot}</body>"
        elif layout == 5:
            page = f"<body>{menu}{div(c, ''.join(div(a, m) for m in made))}{foot}</body>"
        elif layout == 6:
            page = f"<body>{menu}<section>{div(a, body)}</section><section class='comments'><h3>Comments</h3><div class='comment'><p>Thank you, I liked this very much.</p></div></section>{foot}</body>"
        elif layout == 7:
            page = f"<body>{menu}{div(b, div(a, body + '<p hidden>This line is hidden from readers.</p><div style=&quot;display:none&quot;></div>'.replace('&quot;', chr(34))))}<p style='display:none'>Nor is this one ever seen.</p>{foot}</body>"
        elif layout == 8:
            page = f"<body><header><p>The Harbour Post</p></header>{menu}{div(a, made[0])}{div(b, ''.join(made[1:]))}{foot}</body>"
        elif layout == 9:
            page = f"<body>{menu}<table><tr><td class='{a}'>{body}</td></tr></table>{foot}</body>"
        elif layout == 10:
            page = f"<body><div class='cookie-banner'><p>We use cookies to improve our service.</p><button>Accept</button></div>{menu}{div(c, div(a, body))}{foot}</body>"
        elif layout == 11:
            page = f"<body>{div(c, menu)}{div(b, div(a, body) + '<form><label>Your e-mail</label><input><p>Subscribe to our letter.</p></form>')}{div(c, foot)}</body>"
        elif layout == 12:
            page = f"<html><head><title>t</title></head><body id='{b}'>{menu}<div id='{a}'><div>{body}</div></div><div class='sidebar'><h3>Popular</h3><p>Read what others have read this week.</p></div>{foot}</body></html>"
        else:
            page = f"<body>{menu}{div(c, div(a, body) + '<div class=advert><p>Advertisement</p><p>Buy our boots today.</p></div>')}{foot}</body>"
        yield page, said
