"""Packet checks against a plain check of one packet after another."""

import re
from collections import Counter
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from ratefid.functions.text import count_tokens
from ratefid.operators import packet_checks as pc
from ratefid.plans import evidence_queries as eq
from ratefid.plans import registry

registry.load()
SF = "/root/testdata/sf0.001"


def digits(text):
    value = r"[0-9](?:[0-9,]*[0-9])?(?:\.[0-9]+)?(?:st|nd|rd|th)?"
    out = set()
    for m in re.finditer(rf"(?<!\w)[+-]?[$€£]?{value}|(?<=[a-z]){value}", text.lower()):
        v = m[0].replace(",", "")
        out.add(re.sub("(st|nd|rd|th)$", "", v.lstrip("$€£") if v[0] in "$€£" else v))
    return out


def spelled(text):
    words, out, run = re.findall("[a-z]+", text.lower()), set(), []
    units = pc.CARDINALS | pc.ORDINALS
    for w in [*words, "."]:
        if w in units or w in pc.SCALES or (w == "and" and run):
            run.append(w)
        elif run:
            total = now = 0
            for x in run:
                if x in units:
                    now += units[x]
                elif x in pc.SCALES and pc.SCALES[x] == 100:
                    now = max(now, 1) * 100
                elif x in pc.SCALES:
                    total, now = total + max(now, 1) * pc.SCALES[x], 0
            out.add(str(total + now))
            run = []
    return out


def plain(source, gist, residual):
    tokens = lambda t: len(re.findall(r"\w+|[^\w\s]", t, re.A) if t.isascii() else re.findall(r"\w+|[^\w \t\n\x0b\f\r]", t))
    source, gist, residual = source or "", gist or "", residual or ""
    ns, ng, both = tokens(source), tokens(gist), f"{gist} {residual}"
    shown = lambda t: " ".join(re.sub(r"[*_]+", "", re.sub(r"\[\[(?:[^\]|]*\|)?([^\]]+)\]\]", r"\1", t)).lower().split())
    titles = dict.fromkeys(m.strip() for m in re.findall(r"(?im)^Document title:\s*(.+?)\s*$", source))
    names = lambda t: {m[0].lower().replace(",", "") for m in re.finditer(r"\b[A-Z][\w.-]+(?:\s+[A-Z][\w.-]+)*\b", t)}
    numbers = sorted(digits(both) - digits(source) - spelled(source))
    missing = [t for t in titles if shown(t) not in shown(both)]
    fresh = sorted(names(both) - names(source))
    repeats = residual.strip(" ") != "" and SequenceMatcher(None, gist.lower(), residual.lower()).ratio() > 0.8
    tests = [not source.strip(" ") or not gist.strip(" "), ns <= 0, ns > 0 and ng / ns > 0.45, ng >= ns, repeats, bool(numbers), bool(missing)]
    return (
        [e for e, t in zip(pc.ERRORS, tests) if t], [w for w, t in zip(pc.WARNINGS, [residual.strip(" ") == "", bool(fresh)]) if t],
        numbers, missing, fresh,
    )


def test_all_packets_and_every_fault(spark):
    rows = {(r.doc_id, r.packet_id): r for r in eq.planted_packets(spark, SF).collect()}
    got = registry.QUERIES["b24_packet_checks"](spark, SF).collect()
    assert len(got) == len(rows)
    seen = Counter()
    for g in got:
        r = rows[g.doc_id, g.packet_id]
        want = plain(r.source, r.gist, r.residual)
        assert [g.errors, g.warnings, g.new_numbers, g.missing_titles, g.new_names] == ["|".join(w) for w in want], (r, want)
        seen.update(want[0] + want[1])
    assert set(seen) == set(pc.ERRORS + pc.WARNINGS)


def test_numbers_by_value_titles_and_nulls(spark):
    cases = [
        ("Twenty-one thousand, three hundred and five and a half", {"21305"}), ("ninth 9th 9", {"9"}), ("one of the two hundred", {"1", "200"}), ("and five and", {"5"}),
        ("1h21m at $1,200.50 or -3rd, x2,000th 4.", {"1", "21", "1200.50", "-3", "2000", "4"}), ("someone's tenfold", set()), ("", set()), ("hundred thousand millionth", set()),
    ]
    df = spark.createDataFrame([(c, i) for i, (c, _) in enumerate(cases)], "t string, i int")
    both = df.select("i", F.array_union(pc.written_numbers(F.col("t")), pc.spelled_numbers(F.col("t"))).alias("n")).collect()
    for r in both:
        text = cases[r.i][0]
        assert set(r.n) == digits(text) | spelled(text), text
        if r.i not in (7,):
            assert set(r.n) == cases[r.i][1], text
    odd = [(1, None, None, None), (2, "Document title: A\nDocument title: B \nbody of this text is long enough", "b", " "), (3, "x " * 50, "y " * 300, "y " * 299)]
    rows = pc.checked(spark.createDataFrame(odd, "id int, source string, gist string, residual string").withColumn("errors", F.lit(1)).withColumn("new_names", F.lit(1)), count_tokens)
    got = {r.id: r for r in rows.collect()}
    for i, *texts in odd:
        want = plain(*texts)
        assert (got[i].errors, got[i].warnings, got[i].missing_titles) == (want[0], want[1], want[3])
    assert got[2].missing_titles == ["A"]
