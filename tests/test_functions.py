"""Dates, durations and further functions of expressions."""

import pytest

from sylva.plans import moments
from sylva.plans.evaluate import evaluate, string_of
from sylva.plans.xpath import XPathError
from sylva.sources.parsers import parse

DOC = parse("<a><d>2024-02-29</d><d>2023-01-31</d><n>1234.5</n></a>", "xml")
CASES = [
    ("xs:date(//d[1]) + xs:yearMonthDuration('P1Y')", "2025-02-28"), ("xs:date('2024-03-01') - xs:date('2024-02-28')", "P2D"), ("//d[xs:date(.) > xs:date('2023-06-01')]/string()", "2024-02-29"), ("year-from-date(xs:date(//d[1]))", "2024"),
    ("format-date(xs:date('2024-02-05'), '[D1o] [MNn] [Y0001] [FNn,*-3]')", "5th February 2024 Mon"), ("xs:dateTime('2024-01-01T10:00:00+02:00') eq xs:dateTime('2024-01-01T08:00:00Z')", "true"), ("xs:dayTimeDuration('PT36H')", "P1DT12H"),
    ("xs:dayTimeDuration('PT1.5S') * 3", "PT4.5S"), ("max(//d ! xs:date(.))", "2024-02-29"), ("sum((xs:dayTimeDuration('P1D'), xs:dayTimeDuration('PT12H')))", "P1DT12H"), ("adjust-dateTime-to-timezone(xs:dateTime('2024-01-01T10:00:00Z'), xs:dayTimeDuration('PT5H'))", "2024-01-01T15:00:00+05:00"),
    ("xs:dateTime('2024-12-31T24:00:00')", "2025-01-01T00:00:00"), ("xs:time('23:30:00') + xs:dayTimeDuration('PT1H')", "00:30:00"), ("xs:yearMonthDuration('P14M')", "P1Y2M"), ("xs:dayTimeDuration('PT0S')", "PT0S"), ("xs:yearMonthDuration('-P0Y')", "P0M"),
    ("xs:dayTimeDuration('P1D') div xs:dayTimeDuration('PT6H')", "4"), ("avg((xs:dayTimeDuration('PT1H'), xs:dayTimeDuration('PT3H')))", "PT2H"), ("months-from-duration(xs:yearMonthDuration('-P14M'))", "-2"), ("seconds-from-dateTime(xs:dateTime('2024-01-01T00:00:01.25'))", "1.25"),
    ("dateTime(xs:date('2024-01-02'), xs:time('03:04:05Z'))", "2024-01-02T03:04:05Z"), ("timezone-from-date(xs:date('2024-01-02-03:30'))", "-PT3H30M"), ("xs:date('2024-01-01') instance of xs:date", "true"), ("'x' castable as xs:date", "false"), ("xs:date(xs:dateTime('2024-01-01T10:00:00Z'))", "2024-01-01Z"),
    ("format-time(xs:time('15:04:05'), '[h]:[m01] [PN]')", "3:04 PM"), ("format-dateTime(xs:dateTime('2024-01-01T10:00:00.5Z'), '[H01]:[m]:[s].[f1] [Z]')", "10:00:00.5 +00:00"),
    ("format-number(1234567.891, '#,##0.00')", "1,234,567.89"), ("format-number(0.256, '0%')", "26%"), ("format-number(-5, '0;(0)')", "(5)"), ("format-number(0.5, '#.0')", ".5"), ("format-integer(14, 'I')", "XIV"), ("format-integer(28, 'a')", "ab"), ("format-integer(1234567, '#,##0')", "1,234,567"),
    ("round-half-to-even(2.5)", "2"), ("round-half-to-even(1.125, 2)", "1.12"), ("parse-json('{\"a\": [1, {\"b\": 2}]}')?a?2?b", "2"), ("array:size(map:find(parse-json('[{\"k\": 1}, {\"k\": {\"k\": 2}}]'), 'k'))", "3"),
    ("serialize(analyze-string('xa1y', '([a-z])(\\d)'))", '<analyze-string-result><non-match>x</non-match><match><group nr="1">a</group><group nr="2">1</group></match><non-match>y</non-match></analyze-string-result>'),
    ("encode-for-uri('a b/é')", "a%20b%2F%C3%A9"), ("contains-token('a b  c', 'b')", "true"), ("math:log(1)", "0"), ("math:log(0)", "-INF"), ("math:asin(2)", "NaN"), ("array:fold-right([1, 2, 3], '', function($x, $a) { concat($x, $a) })", "123"),
    ("array:put([1, 2], 2, 9)?2", "9"), ("string-join(array:insert-before([1, 2], 3, 9)?* ! string())", "129"), ("parse-xml('<x><y>1</y></x>')//y/string()", "1"), ("string-length(normalize-unicode('é'))", "1"), ("array:for-each-pair([1, 2], [3, 4], function($a, $b) { $a * $b })?2", "8"),
]


@pytest.mark.parametrize("xpath,want", CASES, ids=[c[0][:60] for c in CASES])
def test_functions(xpath, want):
    assert [string_of(x) for x in evaluate(xpath, DOC)] == [want]


@pytest.mark.parametrize("xpath", ["xs:date('2024-13-01')", "xs:date('x')", "xs:date('2024-01-01') + 1", "xs:date('2024-01-01') < xs:time('10:00:00')", "xs:dayTimeDuration('P1Y')", "array:put([1], 2, 3)", "parse-json('{')", "xs:date('9999-12-31') + xs:dayTimeDuration('P1D')", "xs:dayTimeDuration('P')"])
def test_refusals(xpath):
    with pytest.raises((XPathError, moments.MomentError)):
        evaluate(xpath, DOC)


def test_moments_in_results(spark):
    from sylva.operators.engine import Engine
    from sylva.sources.documents import inline

    e = Engine(inline(spark, [("a.json", "json", '{"d": "2024-02-29"}'), ("b.json", "json", '{"d": "no date"}')]))
    assert [r["value"] for r in e.query("xs:date(//d) + xs:dayTimeDuration('P1D')").matches.collect()] == ["2024-03-01"]
    assert e.query("(map { 'd': xs:date(//d) })").matches.first()["tree"] == '{"d": "2024-02-29"}'
