"""Problem 10: the keyword automaton lets through whatever a grammar or the structure of messages would find."""

import itertools
import random
import re
from re import _constants as C
from re import _parser as P

import pytest

from millrace.llm import residue as R

GRAMMARS = {"PLAIN": "placeholder", "AMBIGUOUS": "placeholder", "PROGRAM": "program"}
CATEGORY = {C.CATEGORY_WORD: "q", C.CATEGORY_DIGIT: "1", C.CATEGORY_SPACE: " ", C.CATEGORY_NOT_WORD: ";"}


def one_of(members):
    """What a character class may stand for: each listed character, one of each range or category."""
    if members[0][0] is C.NEGATE:
        no = re.compile(r"\W" if any(x is C.CATEGORY_NOT_WORD for _, x in members) else "[" + "".join(re.escape(chr(x)) for o, x in members if o is C.LITERAL) + "]")
        return [next(c for c in "q1 " if not no.match(c))]
    return [chr(x) if o is C.LITERAL else chr(x[0]) if o is C.RANGE else CATEGORY[x] for o, x in members]


def strings(tree):
    """A string of each alternative of a parsed grammar, repeats at their least and, if that is none, also once."""
    parts = []
    for op, x in tree:
        if op is C.LITERAL:
            parts.append([chr(x)])
        elif op is C.NOT_LITERAL:
            parts.append(["q"])
        elif op is C.ANY:
            parts.append(["q"])
        elif op is C.IN:
            parts.append(one_of(x))
        elif op is C.BRANCH:
            parts.append([s for b in x[1] for s in strings(b)])
        elif op is C.SUBPATTERN:
            parts.append(strings(x[3]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            once = strings(x[2])
            parts.append([s * x[0] for s in once] if x[0] else ["", *once])
        else:
            assert op in (C.AT, C.ASSERT, C.ASSERT_NOT), op
    return ["".join(s) for s in itertools.product(*parts)]


@pytest.mark.parametrize("name", GRAMMARS)
def test_each_alternative_holds_a_key(name):
    grammar = getattr(R, name)
    made = strings(P.parse(grammar.pattern, grammar.flags))
    assert len(made) >= 10
    assert [s for s in made if not any(k in f" {s.lower()} " for k in R.KEYS[GRAMMARS[name]])] == []


def test_no_message_is_kept_from_the_parser():
    """Sentences made of the vocabulary at random: each one that is a message is let through."""
    rng, words = random.Random(1), {k: v.split() for k, v in R._MEANS.items()}
    tried = 0
    for _ in range(20_000):
        names = rng.choices([*words], k=rng.randint(2, 5))
        s = " ".join(rng.choice(words[k]) for k in names) + rng.choice(["", ".", " 404", " here", " later"])
        if R._message(s):
            tried += 1
            assert R._may_be_message(R._keys(s)), s
    assert tried > 1000


@pytest.mark.parametrize("text", ["Servicio no disponible", "RequestId: 0a1b2c3d", "traceid 0a1b2c3d", "403: Zugriff verweigert"])
def test_error_pages_that_had_no_key(text):
    assert R.kinds(text) == ["error_page"]
    assert R.kinds("I like the cup a lot.\n" + text) == ["error_page"]


def test_without_the_automaton(monkeypatch):
    texts = ["404 Not Found", "{{x}}", "I like it.", "Lorem ipsum dolor sit amet.", "Please enable JavaScript."]
    before = [R.kinds(t) for t in texts]
    monkeypatch.setattr(R._keys, "automaton", None)
    assert [R.kinds(t) for t in texts] == before


def test_no_length_ends_a_name_or_a_quotation():
    long = "x" * 500
    assert R.kinds(f"[[{long}]]") == ["placeholder"] and R.kinds("{{" + long + "}}") == ["placeholder"]
    assert R.kinds(f'The card said "{long} {{{{name}}}} {long}" and more.') == []
    assert R.kinds('A 5" screen and {{brand}} on a 7" one.') == ["placeholder"]


def test_tutorials_are_no_residue():
    assert R.kinds("In a template you write {{name}} and it is filled.") == []
    assert R.kinds("```\nHello\n```\nThe syntax of placeholders:\n{{name}}\n```\nBye\n```") == []
    assert R.kinds("A fine cup for {{name}}.") == ["placeholder"]


def test_long_texts_take_linear_time():
    import time

    took = []
    for n in (2_000, 16_000):
        text = 'He said "no {{x" and the page (not found) [a] <b> {{ % $ '.replace("{{x", "x") * n
        began = time.perf_counter()
        R.kinds(text)
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0] + 1
