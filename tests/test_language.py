import pytest

from linequarry.cli import lower_patterns, translate
from linequarry.errors import QueryError
from linequarry.functions.evidence import admit, needle, proof_program
from linequarry.functions.expr import Predicate, parse
from linequarry.functions.regex import NeedsFallback, to_java
from linequarry.functions.strategy import classify, longest_fragment, mandatory_prefix
from linequarry.plans.explain import explain


def test_bar_alone_is_a_literal_and_regex_splits_into_alternates():
    assert parse("a|b").predicates == (Predicate("literal", "a|b"),)
    assert parse("re:a|b").predicates[0].strategy == "regex_literal_alternates"


def test_double_bar_wins():
    plan = parse(" lit:alpha|| prefix:beta && suffix:gamma ")
    assert plan.mode == "any"
    assert [p.value for p in plan.predicates] == ["alpha", "beta && suffix:gamma"]


@pytest.mark.parametrize(("source", "code"), [("", "empty_expression"), (" \t", "empty_expression"), ("&&", "empty_predicate"), ("lit:", "empty_literal"), ("prefix:", "empty_prefix"), ("suffix:", "empty_suffix"), ("||".join("ab" for _ in range(33)), "too_many_predicates")])
def test_errors(source, code):
    with pytest.raises(QueryError) as e:
        parse(source)
    assert e.value.code == code


def test_empty_regex_is_allowed():
    assert parse("re:").predicates[0].kind == "regex"


def test_capabilities():
    literal, alternates = parse("lit:needle").predicates[0], parse("re:alpha|beta").predicates[0]
    assert literal.overlap == 5 and literal.parallel_count and literal.literal_counter
    assert not alternates.parallel_count


@pytest.mark.parametrize(
    ("pattern", "strategy"),
    [
        ("foo", "regex_plain_literal"), (r"a\.b", "regex_plain_literal"), (r"\bfoo\b", "regex_word_boundary_literal"), (r"(?i)\bfoo\b", "regex_ascii_casefold_word_boundary_literal"),
        ("(?i)foo", "regex_ascii_casefold_literal"), ("(?i)a|b", "regex_full"), (r"a\.b|c", "regex_literal_alternates"), (r"a\Db", "regex_fixed_width_bytes"), (r"ab[cd]\d{3}", "regex_fixed_width_bytes"),
        (r"\w+\s+x\s+\w+", "regex_decomposition_candidate_lines"), ("a+b", "regex_full"), ("", "regex_full"), ("a{2,3}", "regex_full"),
    ],
)
def test_strategy(pattern, strategy):
    assert classify(pattern) == strategy


@pytest.mark.parametrize(
    ("pattern", "fragment"),
    [("PM_.*RESUME", "RESUME"), (r"foo\d|barbaz", ""), (r"(?i)hello\d", ""), (r"a\d{10}", "a"), ("ab{0,2}cde", "cde"), ("abc+de", "abc"), ("ab?cd", "cd"), ("x(abc|d)yz", "yz"), (r"a\.b", "a.b"), ("[abc]de", "de")],
)
def test_longest_fragment(pattern, fragment):
    assert longest_fragment(pattern) == fragment


def test_needles():
    assert needle(parse(r"re:\bPM_RESUME\b").predicates[0]) == "PM_RESUME"
    assert needle(parse("lit:x").predicates[0]) == ""
    assert mandatory_prefix(r"^\bauth_\d+") == "auth_"


def test_trigrams():
    assert admit(parse("lit:abcd")).groups == ((0, (b"abc", b"bcd")),)
    assert admit(parse("lit:auth && lit:x")).ignored == 1
    assert admit(parse("lit:auth || lit:x")).reason == "disjunction_has_unindexed_branch"
    assert admit(parse(r"re:auth_\d+")).groups[0][1] == (b"aut", b"uth", b"th_")
    assert admit(parse(r"re:\w+")).reason == "no_mandatory_trigram"
    assert not admit(parse("re:(?i)sherlock")).eligible


def test_proof_program():
    p = proof_program(parse(r"lit:auth && re:token_\d+"))
    assert (p.query_class, p.verifier, p.fallback) == ("conjunctive_regex_with_mandatory_evidence", "regex_window", None) and len(p.terms) >= 5
    p = proof_program(parse(r"re:\d+"))
    assert (p.query_class, p.fallback, p.terms) == ("verifier_only", "no_mandatory_evidence", ())
    assert explain("lit:needle")["proof_program"]["query_class"] == "conjunctive_literal_evidence"


def test_java_translation():
    assert to_java("(?P<x>a)(?P=x)") == r"(?d)(?<x>a)\k<x>"
    assert to_java("[[a&&b]") == r"(?d)[\[a\&\&b]"
    assert to_java("[[:alpha:]_]") == r"(?d)[\p{Alpha}_]"
    with pytest.raises(NeedsFallback):
        to_java(r"foo\Kbar")
    with pytest.raises(QueryError):
        to_java("a\\")


def test_grep_translation():
    assert lower_patterns(["a", "b"], False, False) == "re:a || re:b"
    assert lower_patterns(["a.b"], True, True) == r"re:(?i)a\.b"
    assert lower_patterns(["x"], True, False) == "lit:x"
    assert lower_patterns(["lit:x"], False, False) == "lit:x"
    assert translate(["-F", "-e", "a", "-e", "b", "src"]) == ["search", "lit:a || lit:b", "src"]
    with pytest.raises(QueryError):
        lower_patterns(["a||b"], False, False)
    with pytest.raises(QueryError):
        translate(["--glob", "x"])


def test_one_regex_for_a_query():
    import re

    from linequarry.functions.infer import as_regex

    assert re.search(as_regex("lit:b && lit:a"), "a b") and not re.search(as_regex("lit:b && lit:a"), "a")
    assert re.search(as_regex("prefix:x. || suffix:y"), "ay") and not re.search(as_regex("prefix:x. || suffix:y"), "xay!")
    assert as_regex("a && b && c && d") is None


def test_median_of_samples():
    from linequarry.plans.measure import median_of

    calls = []
    ms, last = median_of(lambda: calls.append(1) or len(calls), warmups=2, samples=3)
    assert len(calls) == 5 and ms >= 0 and last in (3, 4, 5)
