"""Page layouts of the generator: six templates as data, placed on grids by one rule.

A template is a list of parts that follow each other down the page. A part is a run of free lines, a grid of entries
(wording, value) with a count of columns, or the table of line items; a part's height follows from its rows, so nothing
is placed by hand below the first one. What a document doesn't show is left out of its grid and the rest moves up.
Plain templates have fixed wordings and grids, held-out ones have others, and randomised ones draw order, grid and
wording by hashes of the document's seed. Everything is SQL text over the columns of a record, parsed once a template.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAIN = ("claim_form", "invoice")
HELD_OUT = ("claim_form_b", "invoice_b")
RANDOM = ("claim_form_r", "invoice_r")
SEGMENT = "struct<text: string, left: double, top: double, size: double, role: string, field: string>"

#: What can stand in a document: (SQL of its text, role, field, SQL of whether it is shown).
CONTENT = {
    "name": ("concat_ws(' ', first_name, last_name)", "value", "claimant_name", "true"),
    "policy": ("policy_number", "value", "policy_number", "is_form or show_policy"),
    "claim": ("claim_number", "value", "claim_number", "is_form or show_claim_ref"),
    "loss": ("printed_loss", "value", "date_of_loss", "true"),
    "incident": ("incident_type", "value", "incident_type", "true"),
    "provider": ("provider_name", "value", "provider_name", "provider_name is not null"),
    "total": ("printed_total", "value", "total_amount", "true"),
    "birth": ("printed_birth", "distractor", "date_of_loss", "true"),
    "reported": ("printed_reported", "distractor", "date_of_loss", "true"),
    "signed": ("printed_reported", "distractor", "date_of_loss", "true"),
    "issued": ("printed_issued", "distractor", "date_of_loss", "true"),
    "invoice": ("invoice_number", "distractor", "claim_number", "true"),
    "deductible": ("printed_deductible", "distractor", "total_amount", "true"),
    "subtotal": ("printed_subtotal", "distractor", "total_amount", "true"),
    "tax": ("printed_tax", "distractor", "total_amount", "true"),
    "phone": ("phone", "other", None, "true"),
    "home": ("concat_ws(', ', street, city)", "other", None, "true"),
}
#: Wordings of this module's own. The held-out ones stand in no other set, and the randomised ones are drawn from pools.
WORDS = {
    "plain": {
        "name": "Full name", "policy": "Cover number", "claim": "Case number", "loss": "Happened on", "incident": "Kind of event", "provider": "Workshop or practice", "total": "Sum requested",
        "birth": "Born on", "reported": "Told us on", "signed": "Signed on", "issued": "Issued", "invoice": "Account number", "deductible": "Own share", "subtotal": "Before tax", "tax": "Tax", "phone": "Telephone", "home": "Lives at"},
    "plain_invoice": {"name": "Account for", "claim": "Insurer's case", "loss": "Carried out on", "total": "To pay"},
    "held_out": {
        "name": "Member", "policy": "Agreement", "claim": "Dossier", "loss": "Day of the harm", "incident": "Category", "provider": "Seen to by", "total": "Settlement sought",
        "birth": "Birthday", "reported": "Filed", "signed": "Given at hand", "issued": "Sheet of", "invoice": "Sheet", "deductible": "First part", "subtotal": "Works", "tax": "Levy", "phone": "Call", "home": "Mail to"},
    "held_out_invoice": {"name": "On behalf of", "loss": "Rendered", "total": "Owed", "claim": "Dossier of the insurer"},
}
POOLS = {
    "name": ("Insured person", "Covered person", "Your name", "Person insured"), "policy": ("Cover no.", "Plan number", "Plan", "Cover mark"), "claim": ("Case no.", "Your case", "Case mark", "Matter number"),
    "loss": ("It happened on", "Took place on", "Day it happened", "When"), "incident": ("What it was", "Event", "Kind of mishap", "Mishap"), "provider": ("Put right by", "Work done by", "Firm or practice", "Treated by"),
    "total": ("Sum asked for", "Asked for in all", "We should pay", "All in all"), "birth": ("Born", "Day of birth", "Birth day"), "reported": ("Told on", "Notice given", "Letter of"), "deductible": ("You bear", "Own part", "Borne by you"),
    "issued": ("Written on", "Made on", "Day of writing"), "invoice": ("Account no.", "Paper no.", "Our number"), "subtotal": ("Net", "Without tax", "Work and goods"), "tax": ("Tax share", "Duty", "Tax on top"), "phone": ("Phone", "Mobile"), "home": ("Home", "Address"),
}
POOLS_INVOICE = {"name": ("Made out to", "Sent to", "Payer", "Client"), "loss": ("Done on", "Treated on", "Day of work", "Finished on"), "total": ("Please pay", "Sum to pay", "Open sum", "In total"), "claim": POOLS["claim"]}
TITLES = {"claim_form_r": ("HARM AND COST SHEET", "ASKING FOR COVER", "NOTE TO YOUR INSURER"), "invoice_r": ("OUR ACCOUNT", "WORK DONE", "PAYMENT ASKED")}


@dataclass(frozen=True)
class Lines:
    """Free lines: (SQL of text, role, field, letters' height)."""

    lines: Sequence[tuple[str, str, str | None, float]]
    x: str = "64D"
    after: float = 18.0


@dataclass(frozen=True)
class Grid:
    """Entries in columns, row by row; values stand below their words, or beside them at ``tab``."""

    entries: Sequence[str]
    x: str = "64D"
    columns: str = "2"
    width: float = 430.0
    pitch: str = "38D"
    below: str = "false"
    tab: float = 168.0
    size: str = "17D"
    shuffled: bool = False
    after: float = 22.0


@dataclass(frozen=True)
class Items:
    """The line items as a table: heads of (description, count, price, sum) with their x, those without a head left out."""

    heads: Sequence[tuple[str, str, float]]
    pitch: float = 31.0
    after: float = 24.0


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _uniform(*parts: str) -> str:
    named = ", ".join(("cast(seed as string)", "'page'", *parts))
    return f"(cast(conv(substring(sha2(concat_ws('|', {named}), 256), 1, 12), 16, 10) as bigint) / {float(16**12)!r}D)"


def _pick(options: Sequence[str], name: str) -> str:
    return f"element_at(array({', '.join(options)}), cast(floor({_uniform(_text(name))} * {len(options)}) as int) + 1)"


def _segment(text: str, left: str, top: str, size: str, role: str, field: str | None) -> str:
    return f"named_struct('text', cast({text} as string), 'left', cast({left} as double), 'top', cast({top} as double), 'size', cast({size} as double), 'role', {role}, 'field', {field or 'cast(null as string)'})"


def _money(x: str) -> str:
    return f"case amount_format when 'dollar_comma' then concat('$', format_number({x}, 2)) when 'comma' then format_number({x}, 2) when 'dollar_plain' then concat('$', format_string('%.2f', {x})) else concat('CAD ', format_number({x}, 2)) end"


def _lines(part: Lines, y: str) -> tuple[str, str]:
    made, down = [], 0.0
    for text, role, field, size in part.lines:
        made.append(_segment(text, part.x, f"{y} + {down}D", f"{size}D", _text(role), _text(field) if field else None))
        down += 1.5 * size
    return f"array({', '.join(made)})", f"{y} + {down + part.after}D"


def _grid(part: Grid, y: str, words: dict[str, str]) -> tuple[str, str]:
    made = []
    for name in part.entries:
        text, role, field, shown = CONTENT[name]
        at = _uniform(_text(f"order-{name}")) if part.shuffled else f"{len(made)}D"
        made.append(f"if({shown}, named_struct('at', {at}, 'word', {words[name]}, 'text', cast({text} as string), 'role', {_text(role)}, 'field', {_text(field) if field else 'cast(null as string)'}), null)")
    entries = f"array_compact(array({', '.join(made)}))"
    if part.shuffled:
        entries = f"array_sort({entries})"
    left, top = f"({part.x} + {part.width}D * (i % {part.columns}))", f"({y} + {part.pitch} * (i div {part.columns}))"
    word = _segment("e.word", left, top, "13D", "'label'", None)
    value = _segment("e.text", f"{left} + if({part.below}, 0D, {part.tab}D)", f"{top} + if({part.below}, 19D, -3D)", part.size, "e.role", "e.field")
    rows = f"((size({entries}) + {part.columns} - 1) div {part.columns})"
    return f"flatten(transform({entries}, (e, i) -> array({word}, {value})))", f"{y} + {part.pitch} * {rows} + {part.after}D"


def _items(part: Items, y: str) -> tuple[str, str]:
    what = {"description": ("e.description", "'other'", None), "counted": ("if(e.quantity > 1, concat(cast(e.quantity as string), ' of ', e.description), e.description)", "'other'", None), "count": ("e.quantity", "'other'", None),
            "price": (_money("e.price"), "'other'", None), "sum": (_money("e.quantity * e.price"), "'distractor'", "'total_amount'")}
    heads = ", ".join(_segment(_text(word), f"{x}D", y, "13D", "'label'", None) for word, _, x in part.heads)
    row = ", ".join(_segment(what[kind][0], f"{x}D", f"{y} + {part.pitch}D * (i + 1)", "15D", *what[kind][1:]) for _, kind, x in part.heads)
    return f"concat(array({heads}), flatten(transform(line_items, (e, i) -> array({row}))))", f"{y} + {part.pitch}D * (size(line_items) + 1) + {part.after}D"


def _fixed(*sets: str) -> dict[str, str]:
    return {name: _text(word) for s in sets for name, word in WORDS[s].items()}


def _drawn(*pools: dict[str, Sequence[str]]) -> dict[str, str]:
    return {name: _pick([_text(w) for w in words], f"word-{name}") for pool in pools for name, words in pool.items()}


def _head(text: str) -> Lines:
    return Lines([(text, "header", None, 16.0)], after=8.0)


def _templates() -> dict[str, tuple[str, dict[str, str], list]]:
    """Each template's first line, wordings and parts."""
    grid_r = {"x": _pick(["58D", "76D", "94D"], "grid-x"), "columns": _pick(["1", "2"], "columns"), "below": f"{_uniform(_text('mode'))} < 0.5", "pitch": _pick(["48D", "53D", "58D"], "pitch"), "size": _pick(["15D", "16D", "17D"], "size"), "shuffled": True}
    start = f"floor(50 + 40 * {_uniform(_text('start'))})"
    maker = [("provider_name", "value", "provider_name", 23.0), ("concat(maker_street, ', ', maker_city)", "other", None, 14.0), ("concat('T ', maker_phone)", "other", None, 14.0)]
    client = "concat_ws(', ', street, city)"
    return {
        "claim_form": ("62D", _fixed("plain"), [
            Lines([("insurer", "header", None, 25.0), ("concat('Loss notification, ', line_of_business, ' cover')", "header", None, 18.0)]),
            _head("'Who is covered'"), Grid(("name", "policy", "birth", "phone", "home"), after=30.0),
            _head("'What happened'"), Grid(("claim", "loss", "incident", "reported"), after=6.0), Lines([("story", "other", None, 15.0)], after=30.0),
            _head("'Who put it right'"), Grid(("provider",), after=30.0), _head("'Money'"), Grid(("deductible", "total"), after=70.0),
            Lines([("'All of this is so to the best of my knowledge.'", "other", None, 14.0), ("'Insured person signs here'", "label", None, 13.0)]), Grid(("signed",))]),
        "invoice": ("58D", _fixed("plain", "plain_invoice"), [
            Lines([("'Account for services'", "header", None, 24.0)]), Lines(maker, after=26.0), Grid(("name",), tab=130.0, size="19D", after=0.0), Lines([(client, "other", None, 15.0)], x="194D", after=26.0),
            Grid(("invoice", "issued", "loss", "claim", "policy"), columns="1", pitch="29D", size="15D"), Items((("Work", "description", 70.0), ("Count", "count", 500.0), ("Each", "price", 600.0), ("Sum", "sum", 790.0))),
            Grid(("subtotal", "tax", "total"), x="560D", columns="1", pitch="32D", after=60.0), Lines([("'We thank you for the order and ask for payment within a fortnight.'", "other", None, 13.0)])]),
        "claim_form_b": ("84D", _fixed("held_out"), [
            Lines([("'Damage dossier'", "header", None, 30.0), ("concat('kept by ', insurer)", "other", None, 14.0)], x="330D", after=34.0),
            Grid(("claim", "incident", "loss", "reported", "total", "deductible"), columns="3", width=300.0, below="true", pitch="66D", size="18D", after=20.0), Lines([("story", "other", None, 15.0)], after=36.0),
            Grid(("policy", "name", "birth", "home", "phone", "provider"), columns="2", below="true", pitch="60D", after=60.0), Grid(("signed",), x="600D", columns="1", tab=110.0)]),
        "invoice_b": ("70D", _fixed("held_out", "held_out_invoice"), [
            Grid(("invoice", "issued", "loss"), columns="3", width=300.0, below="true", pitch="56D", after=16.0), Lines([("'Sheet of services'", "header", None, 22.0)], x="370D", after=10.0),
            Items((("Sums", "sum", 70.0), ("Services", "counted", 260.0)), pitch=28.0), Grid(("total", "tax", "subtotal"), columns="3", width=300.0, below="true", pitch="60D", size="18D", after=30.0),
            Grid(("name", "claim", "policy"), columns="1", pitch="34D", tab=230.0, after=4.0), Lines([(client, "other", None, 14.0)], after=46.0), Lines(maker, x="420D")]),
        "claim_form_r": (start, _drawn(POOLS), [
            Lines([(_pick([_text(t) for t in TITLES["claim_form_r"]], "title"), "header", None, 22.0), ("insurer", "header", None, 18.0)], x=_pick(["58D", "250D", "480D"], "title-x")),
            Grid(("name", "policy", "claim", "loss", "incident", "birth", "reported", "phone", "provider"), **grid_r, after=26.0), Lines([("story", "other", None, 15.0)], after=34.0), Grid(("deductible", "total"), **grid_r)]),
        "invoice_r": (start, _drawn(POOLS, POOLS_INVOICE), [
            Lines([(_pick([_text(t) for t in TITLES["invoice_r"]], "title"), "header", None, 24.0)], x=_pick(["58D", "330D", "600D"], "title-x")), Lines(maker, x=_pick(["58D", "400D"], "maker-x"), after=22.0),
            Grid(("name", "home"), **grid_r, after=14.0), Grid(("invoice", "issued", "loss", "claim", "policy"), **grid_r), Items((("What", "counted", 70.0), ("How much", "sum", 760.0))),
            Grid(("subtotal", "tax", "total"), x=_pick(["400D", "520D"], "sums-x"), columns="1", pitch="34D", after=10.0)]),
    }


def segments(kind: str) -> Column:
    """The segments of a document of this kind, an array of structs, over a record's columns (the printed ones included)."""
    y, words, parts = _templates()[kind]
    made = []
    for i, part in enumerate(parts):
        one, after = _lines(part, "y") if isinstance(part, Lines) else _grid(part, "y", words) if isinstance(part, Grid) else _items(part, "y")
        made.append((one, after))
    # each part begins where the one before ends: {y, out} goes through them
    state = f"named_struct('y', cast({y} as double), 'out', cast(array() as array<{SEGMENT}>))"
    for one, after in made:
        step = f"element_at(transform(array(s.y), y -> named_struct('y', cast({after} as double), 'out', concat(s.out, {one}))), 1)"
        state = f"element_at(transform(array({state}), s -> {step}), 1)"
    return F.expr(f"{state}.out")
