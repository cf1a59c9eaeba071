"""A byte-pair vocabulary as a text: a header, the splitter's switches, special tokens, then merges in the order learnt."""

from __future__ import annotations

from dataclasses import dataclass

from .bpe import Splitter

#: The name of each switch in the file, beside its field.
SWITCHES = (("ansi", "ansi"), ("underscore", "underscore"), ("prefix", "prefix"), ("digits", "digits"), ("punct_newlines", "newlines"), ("whitespace", "whitespace"))
CHOICES = {"ansi": ("0", "1"), "underscore": ("0", "1"), "punct_newlines": ("0", "1"), "prefix": ("space", "any"), "whitespace": ("gpt2", "cl100k"), "digits": tuple(map(str, range(256)))}


def special_errors(specials: tuple[str, ...]) -> list[str | None]:
    """What is wrong with each special token, or None."""
    return [
        "empty" if not s else "has a line break" if "\n" in s or "\r" in s else "has spaces at an end" if s.strip() != s else "is listed twice" if s in specials[:k] else None
        for k, s in enumerate(specials)
    ]


@dataclass(frozen=True)
class Vocabulary:
    """Ids 0 to 255 are bytes, merges follow, special tokens come last; ValueError for a merge of ids to come or a bad special token."""

    splitter: Splitter
    merges: tuple[tuple[int, int], ...] = ()
    specials: tuple[str, ...] = ()

    def __post_init__(self):
        for k, pair in enumerate(self.merges):
            if max(pair) >= 256 + k or min(pair) < 0:
                raise ValueError(f"merge {k} names an id that isn't known yet")
        if len(set(self.merges)) < len(self.merges):
            raise ValueError("a merge is listed twice")
        for special, error in zip(self.specials, special_errors(self.specials), strict=True):
            if error:
                raise ValueError(f"special token {special!r} {error}")

    def pieces(self) -> dict[int, bytes]:
        """The bytes of each id."""
        found = [bytes([b]) for b in range(256)]
        for a, b in self.merges:
            found.append(found[a] + found[b])
        return dict(enumerate([*found, *(s.encode() for s in self.specials)]))

    def dumps(self, header: str = "vocabulary 1") -> str:
        values = {name: getattr(self.splitter, field) for name, field in SWITCHES}
        switches = " ".join(f"{name}={int(v) if isinstance(v, bool) else v}" for name, v in values.items())
        return "\n".join([header, f"pretokenizer {switches}", *(f"special {s}" for s in self.specials), *(f"merge {a} {b}" for a, b in self.merges), ""])


def loads(text: str, header: str = "vocabulary 1") -> Vocabulary:
    """The vocabulary of a text; ValueError names the line that is wrong."""
    lines = text.removesuffix("\n").split("\n")
    if lines[0] != header:
        raise ValueError(f"line 1: not `{header}`")
    word, *switches = (lines[1] if len(lines) > 1 else "").split() or [""]
    given = [s.partition("=")[::2] for s in switches]
    if word != "pretokenizer" or sorted(n for n, _ in given) != sorted(CHOICES) or any(v not in CHOICES[n] for n, v in given):
        raise ValueError("line 2: not `pretokenizer` with each switch once and a value it can have")
    values = dict(given)
    splitter = Splitter(values["ansi"] == "1", values["underscore"] == "1", values["prefix"], int(values["digits"]), values["punct_newlines"] == "1", values["whitespace"])
    specials, merges = [], []
    for no, line in enumerate(lines[2:], 3):
        kind, _, rest = line.partition(" ")
        if kind == "special" and not merges:
            specials.append(rest)
        elif kind == "merge" and len(ids := rest.split(" ")) == 2 and all(i.isascii() and i.isdigit() for i in ids):
            merges.append((int(ids[0]), int(ids[1])))
        else:
            raise ValueError(f"line {no}: expected a special token before the merges, or `merge <id> <id>`")
    return Vocabulary(splitter, tuple(merges), tuple(specials))
