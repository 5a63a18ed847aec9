"""Secret scans by assignment-aware lexing.

Three base patterns are matched over the whole text: assignments to a password-like name, access key
ids, long lower-case hex runs. Beside them a lexer reads source and configuration syntax into
name-literal pairs (``name = "x"``, ``name: x``, ``"name": "x"``, ``NAME=x``, ``name := 'x'``, ``map["name"] = 'x'``, ``name => x``),
keeps the constants that a text binds, and carries them through later names and concatenations
(``A = "..."; client_secret = A + "..."``). A literal is scored by the target name it reaches (how
sensitive its parts are) and by its own form (length, classes of characters, entropy; words of prose,
placeholders and references score nothing). Literals may be of any length, in brackets, over several lines (triple quotes, back ticks,
YAML blocks, quotes around a PEM block or lines of one word, continued or concatenated lines) or on the line after the
name. A literal that is put together several times counts once, and one that was found already not again. PEM private keys under any sensitive name and phrases of some words in quotes under a strong one count as secrets. Literals of ``LEAST`` or more that no base span
covers are added as spans of kind ``lex``.

Every row is worked on by itself: nothing shuffles, and only lines that hold an assignment sign are
searched for names. Defined results: null text is empty; texts without a match give zero counts, an empty span
list and the hash of the empty string; repeated rows are rows of their own.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of HEX that are long enough: runs are maximal
NAMED = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
LEAST = 0.6

PAIR = re.compile(
    r"""(?P<nq>["'`]?)(?P<name>[A-Za-z_$][A-Za-z0-9_$.-]{0,80})(?P=nq)(?:\[\s*["']?(?P<key>[A-Za-z_][\w.-]{0,80})["']?\s*\])?"""
    r"""[ \t]*(?P<op>:=|=>|:(?!/)|=(?!=))[ \t]*"""
)
QUOTED = re.compile(r"""[A-Za-z@$]{0,2}(?:"(?!"")(?P<d>(?:[^"\\\n]|\\[\s\S])*+)"|'(?!'')(?P<s>(?:[^'\\\n]|\\[\s\S])*+)')""")
OVER = {q: re.compile(rf"{q}((?:[^{q}\\]|\\[\s\S])*+){q}(?=[ \t]*[,;)\]}}]*[ \t]*(?:\r?\n|\Z))") for q in "\"'"}
OPEN = re.compile(r"""[A-Za-z@$]{0,2}(\"{3}|'{3}|`)""")
WORD = re.compile(r"""[^\s"'`,;(){}\[\]+]+""")
YAML = re.compile(r"[|>][+-]?[0-9]?[+-]?[ \t]*\r?\n")
SPACE = re.compile(r"[ \t]*(?:\\?\r?\n[ \t]*)*")
JOINT = re.compile(r"[ \t]*(?:\\?\r?\n[ \t]*)?(?:\+|\.\.|\|\|)[ \t]*(?:\\?\r?\n[ \t]*)?")
BESIDE = re.compile(r"""(?:[ \t]*\\\r?\n)?[ \t]*(?=["'])""")
PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY( BLOCK)?-----")
IDENT = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*\Z")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
STRONG = {"password", "passwd", "passphrase", "pwd", "secret", "apikey", "credential", "credentials", "token", "bearer", "privatekey", "accesskey", "authtoken", "secretkey"}
WEAK = {"auth", "pass", "signing", "encryption", "private", "access", "cookie", "session", "salt", "key", "dsn"}
PLACEHOLDER = re.compile(r"(?i)\A(?:x+|\*+|\.+|-+|<.*>|\$\{.*|\$\(.*|\{\{.*|%.*%|your.*|change.?me.*|example.*|placeholder.*|none|null|nil|true|false|undefined|redacted|todo|dummy.*|test|password|secret|token)\Z")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), kind 0 assign, 1 access, 2 hex, by start and kind."""
    found = [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if NAMED.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    return sorted(found)


def name_score(name: str) -> float:
    """How sensitive a name is: by its parts, and by neighbouring parts together."""
    parts = [p.lower() for p in PARTS.findall(name)]
    both = set(parts) | {a + b for a, b in zip(parts, parts[1:], strict=False)}
    return 1.0 if both & STRONG else 0.4 + 0.3 * (len(both & WEAK) > 1) if both & WEAK else 0.0


def literal_score(value: str, phrase: bool = False) -> float:
    """How much a literal looks like a generated secret rather than prose, a path or a placeholder; phrase: words may be a passphrase."""
    if PEM.search(value):
        return 1.0
    if "\n" in value and all(len(x.split()) < 2 for x in value.split("\n")):
        value = "".join(value.split())
    if len(value) < 8 or PLACEHOLDER.match(value):
        return 0.0
    if re.search(r"\s", value):
        words = value.split()
        return 0.6 if phrase and len(words) > 1 and "\n" not in value and len(set(words)) > 1 else 0.0
    n = Counter(value)
    entropy = -sum(k / len(value) * math.log2(k / len(value)) for k in n.values())
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    if classes == 1 and not value.isdigit() and entropy < 3.5:
        return 0.2
    return min(1.0, 0.35 + 0.1 * classes + 0.08 * max(0.0, entropy - 2))


class Item:
    """Literals that are put together: atoms (start, end, whether quoted), and items that a name bound before, which are shared and not copied."""

    __slots__ = ("found", "parts")

    def __init__(self, parts: list):
        self.parts = parts
        self.found = False

    def atoms(self) -> tuple[list[tuple[int, int, bool]], list[Item]]:
        """(the atoms in order, each once; the items they come from), but for items found already."""
        out: dict[tuple[int, int, bool], None] = {}
        seen: dict[int, Item] = {}
        todo: list = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, Item):
                if not x.found and id(x) not in seen:
                    seen[id(x)] = x
                    todo += reversed(x.parts)
            else:
                out[x] = None
        return list(out), list(seen.values())


class Lexer:
    """Values of pairs: lists of items."""

    def __init__(self, text: str):
        self.text = text
        self.bound: dict[str, list[Item]] = {}
        self.unclosed: set[str] = set()
        self.word = (0, 0)

    def quoted(self, pos: int, stop: int) -> tuple[int, int, int] | None:
        """(start, end, where it goes on) of the literal in quotes at pos."""
        text = self.text
        if (o := OPEN.match(text, pos, stop)) and o[1] not in self.unclosed:
            if (end := text.find(o[1], o.end(), stop)) >= 0:
                return o.end(), end, end + len(o[1])
            if stop == len(text):
                self.unclosed.add(o[1])
        if m := QUOTED.match(text, pos, stop):
            return m.start(m.lastgroup), m.end(m.lastgroup), m.end()
        q = text[pos : pos + 1]
        if q in OVER and q and q not in self.unclosed:
            if (m := OVER[q].match(text, pos, stop)) and literal_score(m[1]) > 0:
                return m.start(1), m.end(1), m.end()
            if text.find(q, pos + 1) < 0:
                self.unclosed.add(q)
        return None

    def plain(self, pos: int, stop: int) -> tuple[int, int] | None:
        """The word at pos; a run of its characters is read once."""
        if not self.word[0] <= pos < self.word[1]:
            if not (m := WORD.match(self.text, pos)):
                return None
            self.word = m.span()
        return (pos, min(self.word[1], stop)) if pos < stop else None

    def block(self, pos: int, stop: int, indent: int) -> tuple[int, int] | None:
        """The YAML block from the line at pos on: lines indented deeper than its name."""
        first, last = -1, pos
        while pos < stop:
            end = self.text.find("\n", pos, stop)
            end = stop if end < 0 else end
            line = self.text[pos:end]
            if line.strip():
                if len(line) - len(line.lstrip()) <= indent:
                    break
                first = pos + len(line) - len(line.lstrip()) if first < 0 else first
                last = pos + len(line.rstrip())
            pos = end + 1
        return (first, last) if first >= 0 else None

    def value(self, m: re.Match, stop: int) -> list[Item]:
        text, pos, depth = self.text, m.end(), 0
        items: list[list] = [[]]
        line = text.rfind("\n", 0, m.start()) + 1
        head = text[line : m.start()]
        indent = len(head) - len(head.lstrip())
        if m["op"] == ":" and (y := YAML.match(text, pos, stop)):
            return [Item([(*b, True)])] if (b := self.block(y.end(), stop, indent)) else []
        start = pos
        pos = SPACE.match(text, pos, stop).end()
        next_line = "\n" in text[start:pos]
        while pos < stop:
            if text[pos] in "([":
                depth, pos = depth + 1, pos + 1
            elif q := self.quoted(pos, stop):
                items[-1].append((q[0], q[1], True))
                pos = q[2]
                if j := JOINT.match(text, pos, stop) or BESIDE.match(text, pos, stop):
                    pos = j.end()
                    continue
                if not depth:
                    break
            elif text[pos] in ")]" and depth:
                depth, pos = depth - 1, pos + 1
                if not depth:
                    if not (j := JOINT.match(text, pos, stop)):
                        break
                    pos = j.end()
                    continue
            elif text[pos] == "," and depth:
                items.append([])
                pos += 1
            elif w := self.plain(pos, stop):
                j = JOINT.match(text, w[1], stop)
                name = text[pos : w[1]] if w[1] - pos < 100 else ""
                if IDENT.match(name) and (name in self.bound or j):
                    items[-1] += self.bound.get(name, [])
                elif depth or next_line and (pos - text.rfind("\n", 0, pos) - 1 <= indent or text[w[1] : w[1] + 2].strip() or ":" in text[w[0] : w[1]] or "=" in text[w[0] : w[1]]):
                    break
                else:
                    items[-1].append((*w, False))
                pos = w[1]
                if j:
                    pos = j.end()
                    continue
                if not depth:
                    break
            else:
                break
            if depth:
                pos = SPACE.match(text, pos, stop).end()
        return [Item(x) for x in items if x]


def lexed_spans(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name, itself or through constants."""
    if "=" not in text and ":" not in text:
        return []
    lexer = Lexer(text)
    found: set[tuple[int, int]] = set()
    within: list[tuple[int, int, int]] = []  # literals in quotes, with where what is around them ends: pairs in one end with it
    at = 0
    for line in text.splitlines(keepends=True):
        if "=" in line or ":" in line:
            for m in PAIR.finditer(text, at, at + len(line.rstrip("\r\n"))):
                while within and within[-1][1] <= m.start():
                    within.pop()
                if within:
                    stop = within[-1][1] if within[-1][0] <= m.start() else within[-1][2]
                else:
                    stop = len(text)
                name = m["key"] or m["name"]
                items = lexer.value(m, stop)
                if not items:
                    continue
                own = (a for x in items for a in x.parts if not isinstance(a, Item))
                within += sorted(((s, e, stop) for s, e, quoted in own if quoted and m.end() <= s), reverse=True)
                lexer.bound[name.rpartition(".")[2]] = items
                sensitive = name_score(name)
                for item in items if sensitive else ():
                    atoms, held = item.atoms()
                    score = literal_score("".join(text[s:e] for s, e, _ in atoms), sensitive == 1.0 and all(q for *_, q in atoms))
                    if 0.5 * sensitive + 0.5 * score >= LEAST and score > 0.4:
                        found.update((s, e) for s, e, _ in atoms if e > s)
                        for x in held:
                            x.found = True
        at += len(line)
    return sorted(found)


KINDS = ("assign", "access", "hex", "lex")


def scan(text: str | None) -> tuple[int, int, int, str, str]:
    """(n_assign, n_access, n_hex, base_sha256, spans) of a text."""
    text = text or ""
    base = base_spans(text)
    count = [sum(k == kind for _, k, _ in base) for kind in range(3)]
    say = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
    more = [(s, 3, e) for s, e in lexed_spans(text) if not any(s < z and a < e for a, _, z in base)]
    return *count, hashlib.sha256(say(base).encode()).hexdigest(), say(sorted(base + more))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    def run(batches):
        for batch in batches:
            cols = list(zip(*map(scan, batch.column(1).to_pylist()), strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    slim = docs.select(docs[id_col], docs[text_col])
    return slim.mapInArrow(
        run, f"doc_id {slim.schema[0].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def redact(text: str | None, mark: str = "[secret]") -> str | None:
    """The text with every span replaced; null stays null."""
    if text is None:
        return None
    spans = sorted((int(s), int(e)) for _, s, e in (x.split(":") for x in scan(text)[4].split(",") if x))
    out, at = [], 0
    for s, e in spans:
        if e > at:
            out += [text[at : max(s, at)], mark if s >= at else ""]
            at = e
    return "".join([*out, text[at:]])


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
