"""The labelled table: small pages of varied text and layout, main blocks marked with `data-main`.

Every layout is filled with several sets of texts, so that the tree sees each arrangement with short
and long, plain and linked blocks. Some names mislead on purpose.
"""

# Sets of (title, long paragraphs, short paragraphs, list items).
TEXTS = [
    ("The bridge that would not close", [
        "Engineers who studied the river for two years told the meeting that the old crossing could carry traffic "
        "for another decade, but only if its piers were strengthened before the winter floods and the heavy lorries "
        "were sent along the northern road instead.",
        "Nobody in the hall seemed surprised. The report had been promised for the spring, then for the summer, and "
        "when it came at last most of its findings were already known to those who cross the bridge every day and who "
        "hear the planks move under their wheels.",
        "A second reading is planned for May."],
        ["They agreed.", "Not everyone did.", "“We waited long enough,” said the mayor."],
        ["Two new piers", "A lower speed limit", "Weekly checks"]),
    ("Baking with rye", [
        "Rye flour takes up more water than wheat and gives it back slowly, so the dough stays sticky however long it "
        "is worked. Wet hands help, and so does patience: an hour of rest does more than ten minutes of kneading ever "
        "will, as every old recipe says in one way or another.",
        "Set the oven as hot as it goes and put a tray of water on its floor. After a quarter of an hour turn it down "
        "and let the loaf finish in falling heat, which keeps the crust thin."],
        ["Wait a day before cutting it.", "Enjoy!", "Makes two loaves."],
        ["500 g rye flour", "400 ml warm water", "One spoon of salt", "Starter from the day before"]),
    ("Der Winter im Hafen", [
        "Im November werden die letzten Boote aus dem Wasser gehoben, und auf den Stegen bleiben nur die Möwen und ein "
        "paar Angler zurück, die auch im Schneeregen noch auf Dorsche warten und kaum ein Wort miteinander wechseln.",
        "Wer jetzt kommt, hat den Ort für sich. Die Zimmer kosten die Hälfte, das Brot ist noch warm, wenn man früh "
        "genug aufsteht, und der Wirt erzählt von dem Sturm, der vor zwanzig Jahren die Mole zerbrach."],
        ["Dann wird es still.", "So war es immer.", "Im März beginnt alles von vorn."],
        ["Fähre um acht", "Markt am Samstag", "Leuchtturm"]),
    ("Une bibliothèque sous les toits", [
        "La salle de lecture occupe tout le dernier étage, et la lumière y tombe de hautes fenêtres que personne n'a "
        "lavées depuis des années ; les habitués s'en plaignent chaque automne, mais ils reviennent quand même s'asseoir "
        "à la même place, avec les mêmes livres.",
        "On y garde aussi les plans de la ville ancienne, que l'on peut consulter sur demande deux jours par semaine."],
        ["Entrée libre.", "C'est peu.", "Il faut monter cinq étages."],
        ["Plans anciens", "Journaux du siècle dernier"]),
    ("Notas de campo", [
        "Salimos antes del amanecer porque al mediodía el calor no deja trabajar a nadie, y cuando el sol tocó la "
        "ladera ya habíamos contado más de cuarenta nidos, casi todos en la parte alta, donde el viento barre la nieve "
        "y la hierba aparece antes que en el valle.",
        "El informe completo se publicará en otoño, junto con los mapas y las medidas de cada nido."],
        ["Nada más.", "Volveremos en junio.", "La cuenta fue exacta."],
        ["Cuarenta nidos", "Dos águilas", "Ningún zorro"]),
]
_CHROME = [
    ["Home", "News", "Sport and weather", "About us", "Contact"],
    ["Startseite", "Aktuelles", "Archiv", "Über uns"],
    ["Accueil", "Nos livres", "Horaires", "Presse"],
]
_NOTICES = [
    "We use cookies to make this site better for you. By going on you accept our terms of use.",
    "Buy two, pay one, this week only in all our shops.",
    "Sign up for the weekly letter and never miss a story.",
    "Wir verwenden Cookies, um Ihnen die Nutzung zu erleichtern.",
    "Great read! I have waited for someone to say this for years, thank you so much.",
]


def _links(words: list, tag: str = "li") -> str:
    return "".join(f'<{tag}><a href="/{i}">{w}</a></{tag}>' for i, w in enumerate(words))


def _main(text: tuple, linked: bool = True) -> str:
    """Title, paragraphs long and short in turn, a list, a last word; with linked blocks if asked."""
    title, long, short, items = text
    parts = [f"<h1 data-main>{title}</h1>"]
    for i, p in enumerate(long):
        parts.append(f"<p data-main>{p}</p>")
        parts.append(f"<p data-main>{short[i % len(short)]}</p>")
    parts.append("<ul>" + "".join(f"<li data-main>{x}</li>" for x in items) + "</ul>")
    parts.append(f'<p data-main>{long[0]} <a href="/s">{items[0]}</a></p>')
    if linked:
        parts.append(f'<p data-main><a href="/t">{short[0]}</a></p><p data-main>{short[1]} <a href="/u">{title}</a></p>'
                     f'<ol>{"".join(f"<li data-main><a href=/{x[0]}>{x}</a></li>" for x in items)}</ol>')
    parts.append(f'<p data-main>{short[-1]}</p>')
    return "".join(parts)


def _prose(text: tuple) -> str:
    """Paragraphs only."""
    _, long, short, _ = text
    return "".join(f"<p data-main>{p}</p>" for p in [long[0], short[0], *long[1:], short[1], long[0]])


def _layouts(text: tuple, menu: list, notice: str, other: str) -> list:
    title, long, short, _ = text
    nav, main, plain = _links(menu), _main(text), _main(text, False)
    comments = f"<h3>{len(menu)} replies</h3><p>{other}</p><p>{notice} {other}</p>"
    own = "".join(f'<li data-main><a href="/o">{x}</a></li>' for x in (*text[3], title, *menu[:3]))
    return [
        # Landmarks around an article; an advert between.
        f'<head><title>{title}</title></head><nav><ul>{nav}</ul></nav><div class="ad">{notice}</div><article>{main}'
        f'</article><footer>&copy; {title}. {notice}</footer>',
        f'<header><p>{menu[0]}</p><form>Search the archive</form></header><main>{main}<aside><p>{long[0]}</p></aside>'
        f'<section class="comments">{comments}</section></main><footer><p>{short[0]}</p><p>{long[0]}</p></footer>',
        # Named containers.
        f'<div id="header">{menu[0]}</div><div class="menu"><ul>{nav}</ul></div><div id="content">{main}</div>'
        f'<div class="sidebar"><h3>{short[0]}</h3><p>{other}</p><p>{notice}</p></div><div id="footer">{short[1]}</div>',
        f'<div class="top-bar">{notice}</div><section class="entry-content">{main}<div class="newsletter-box"><p>'
        f'{notice}</p><p>{short[0]}</p></div></section><div class="related-links"><ul>{_links(menu)}</ul></div>',
        # No hints at all: words and links of the neighbours decide.
        f'<div>{_links(menu, "span")}</div><p><a href="/x">{menu[1]} {menu[0]}</a></p>{plain}<p><a href="/y">{menu[-1]}'
        f'</a></p><div>{menu[0]}</div>',
        f'<table><tr>{_links(menu, "td")}</tr><tr><td>{menu[0]}</td></tr></table>{_prose(text)}<p><a href="/m">{menu[1]}'
        f'</a> {menu[0]}</p><p>{menu[-1]} 1</p>',
        f'<p><a href="/">{menu[0]}</a></p>{_prose(text)}<ul>{nav}</ul><p>&copy; {menu[0]}</p>',
        f'<ul>{nav}</ul><div>{_links(menu[::-1], "p")}</div>{_prose(text)}{_links(menu, "p")}',
        # Names that mislead: long prose between long prose is main text, whatever holds it.
        f'<ul>{nav}</ul><div class="widget"><p data-main>{long[0]} {long[0]}</p><p data-main>{long[1]} {long[0]}</p>'
        f'<p data-main>{long[0]} {long[1]}</p><p data-main>{long[1]} {long[0]}</p></div><p>{menu[0]}</p>',
        f'<div class="content"><ul>{_links(menu)}</ul></div>{_prose(text)}<div class="main"><p><a href="/z">{menu[1]}</a>'
        f'</p>{_links(menu, "p")}</div>',
        # Pages that begin with the article, or are cut off inside it.
        f'<article>{main}', f'<main>{main}</main><footer>{menu[0]}</footer>', f'<div class="post">{main}</div>',
        f'<nav>{nav}</nav><article><h1 data-main>{title}</h1>{_prose(text)}', f'<article>{_prose(text)}</article>',
        f'<article><p data-main>{long[-1]}</p></article>', f'<main><p data-main>{short[0]}</p></main>{nav}',
        # Lists of links and linked paragraphs belong to an article that holds them.
        f'<nav>{nav}</nav><main><p data-main><a href="/q">{long[0]}</a></p><p data-main>{short[0]}</p><ul>{own}</ul>'
        f'</main><p>{menu[0]}</p>',
        f'<article><header><h2 data-main><a href="/t">{title}</a></h2></header><ul>{own}</ul>{_prose(text)}<ol>{own}</ol>'
        f'</article><p>{_links(menu, "span")}</p>',
        f'<div>{notice}</div><article><ul>{own}</ul><p data-main>{short[1]}</p><p data-main>{long[1]}</p><p data-main>'
        f'{short[0]}</p></article><div>{notice}</div>',
        # Nothing but chrome.
        f'<nav><ul>{nav}</ul></nav><div class="cookie-notice">{notice} {other}</div><aside>{long[0]}<p>{short[0]}</p>'
        f'</aside><footer><p>{long[0]}</p><p>{short[0]}</p></footer>',
        f'<p><a href="/">{menu[0]}</a></p>{_links(menu, "p")}<p><a href="/4">{short[0]} {menu[1]}</a></p><p>'
        f'<a href="/5">{menu[-1]}</a> {menu[0]}</p><div class="popup">{notice}</div>',
        # Articles of a few words.
        f'<nav>{nav}</nav><article><h1 data-main>{title}</h1><p data-main>{short[0]}</p></article><footer>{menu[0]}'
        f'</footer>',
    ]


LABELLED = ["<body>" + page for i, text in enumerate(TEXTS) for page in _layouts(
    text, _CHROME[i % len(_CHROME)], _NOTICES[i % len(_NOTICES)], _NOTICES[(i + 4) % len(_NOTICES)])]
