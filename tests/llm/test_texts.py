import itertools
import random
import re

from pyspark.sql import functions as F

from lekhya.llm import addresses, leak, mix, ocr_repair, residue, split


def test_p2_lines(spark):
    sayings = ["amber", "birch", "cedar", "dune", "ember", "fern", "grove", "heath"]  # every page says something else
    body = lambda x: [f"The {x} vendor has handed over the keys to the purchaser in the pres-", f"ence of {x} witnesses and the regis-", f"trar of {x} at this sub-registrar office, and the purchaser", f"has {x} received the keys of the house."]
    rows = [(1, p, "Page %d of 9\n%s\n\nCONFIDENTIAL" % (p, "\n".join(body(sayings[p - 1])))) for p in range(1, 9)]
    bad = "Page 9 of 9\nThe vendor has handed over the kcys on 1O March 2O15 at the sub-\nregistrar office of\n\nthe purchaser and the hou-\n\n9"
    rows += [(1, 9, bad), (1, 9, bad), (1, 10, None), (1, 11, "se of the vendor."), (2, 1, "")]
    pages = spark.createDataFrame(rows, "doc_id long, page_number int, text string").withColumn("confidence", F.lit(0.5))
    cleaned = spark.createDataFrame([], "doc_id long, original string")
    got = {(r.page_number, r.line_no, r.kind) for r in ocr_repair.found(pages, cleaned).collect()}
    assert {(1, 0, "furniture"), (1, 1, "hyphen"), (1, 2, "hyphen"), (1, 6, "furniture")} == {x for x in got if x[0] == 1}
    assert {x for x in got if x[0] == 9} == {(9, 0, "furniture"), (9, 1, "misread"), (9, 4, "hyphen"), (9, 6, "furniture")}
    # the stamp that stands across sentences, and the running lines, are learned
    text = " ".join(r.text for r in ocr_repair.paragraphs(pages).orderBy("para_no").collect())
    assert "presence of amber witnesses and the registrar of amber at" in text and "has handed over the keys on 10 March 2015" in text and "the house of the vendor" in text and "CONFIDENTIAL" not in text
    assert ocr_repair.found(pages.limit(0), cleaned).count() == 0


def test_p2_furniture_is_learned_whatever_its_words(spark):
    rng = random.Random(21)
    vocab = "the seller gives land near old river bank with all rights and trees to buyer who pays price before witness at village".split()
    rows = []
    for d in range(8):
        for p in range(1, 5):
            body = []
            for _ in range(4):  # wrapped paragraphs
                words, line = [rng.choice(vocab) for _ in range(30)], ""
                for w in words:
                    if len(line) + 1 + len(w) > 50:
                        body.append(line)
                        line = ""
                    line = f"{line} {w}".strip()
                body.append(line + ".")
            if p == 2:
                body.insert(2, "ZEPHYR GUILD")  # a stamp across a sentence
            title = ["QUITCLAIM WRIT", ""] if p == 1 else []
            rows.append((d, p, "\n".join([f"Quill {p} ov {d + 4}", *title, *body, "Kept by the moonlit guild" if p % 3 else "Kept by the rnoonlit guiId"])))
    pages = spark.createDataFrame(rows, "doc_id long, page_number int, text string")
    got = {(r.doc_id, r.page_number, r.line_no) for r in ocr_repair.found(pages, spark.createDataFrame([], "doc_id long, original string")).filter("kind = 'furniture'").collect()}
    want = set()
    for d, p, t in rows:
        want |= {(d, p, k) for k, x in enumerate(t.split("\n")) if x.startswith(("Quill", "Kept")) or x == "ZEPHYR GUILD"}
    assert got == want  # the title, once in each document, is deed text


def test_p2_plain_edits_and_context_at_the_parameters_in_use():
    words = {"registration": 900, "boundary": 700, "of": 5000, "the": 9000, "stones": 400, "fee": 600, "a": 3000, "sale": 800, "house": 900, "kalyanagiri": 500, "vendor": 900, "send": 200, "east": 500, "ensued": 90}
    pairs = {("the", "boundary"): 90, ("boundary", "stones"): 80, ("the", "registration"): 90, ("registration", "fee"): 70, ("the", "vendor"): 99}
    lex = ocr_repair.Lexicon(words, pairs, names=frozenset({"kalyanagiri"}))
    assert ocr_repair.repair_line("the registrtion fee, the boundarry stones", lex) == "the registration fee, the boundary stones"
    assert ocr_repair.repair_line("the vebdor of the bounxary stones", lex) == "the vebdor of the boundary stones"  # no neighbour after vebdor
    assert ocr_repair.repair_line("the $ale of o house", lex) == "the sale of a house"
    assert ocr_repair.repair_line("the Kalyxnagiri stones, THE BOUNDXRY STONES", lex) == "the Kalyxnagiri stones, THE BOUNDXRY STONES"
    for word in ("registrtion", "boundry", "boundarry", "vebdor"):
        assert lex.candidates(word)
    for line in ("the registrtion fee", "the $ale of o house", "Tbe b0undary st0nes"):  # one walk for both
        edits = ocr_repair.word_edits(line, lex)
        assert edits and ocr_repair.findings([line], ["deed"], None, None, lex) == [(0, "misread")]
    assert not ocr_repair.findings(["the sale of a house"], ["deed"], None, None, lex)


def test_automaton_finds_all_lexicon_words_within_the_cost():
    rng = random.Random(4)
    words = {"".join(rng.choice("abcde") for _ in range(rng.randint(2, 5))): 10 for _ in range(300)}
    lex = ocr_repair.Lexicon(words)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    saved, ocr_repair.CONFUSIONS = ocr_repair.CONFUSIONS, {}
    try:
        for w in list(words)[:40]:
            got = set(lex.candidates(w, limit=2, plain=1))
            assert got == {v for v in words if v != w and distance(w, v) <= 2} | (got & {w})
    finally:
        ocr_repair.CONFUSIONS = saved


def test_p4_addresses(spark):
    many = [(k, "LOCATION", t) for k, t in enumerate(
        ["Flat 6-A, Cedar Homes, No. 12/3, East Mandara Main Road, Opp. Bus Stand, Tulsipura Colony, Neelambur - 911 446", "TULSIPURA COL., F.NO. 6A, # 12/3, E. MANDARA MN RD, 911446",
         "Flat 6-ACedar Homes12/3 East Mandara Main RoadTulsipura Colony", "No. 12/3, East Mandra Main Rd; Tulsipura Cly", "12/3, East Mandara Main Road, Tulsipura Colony, PIN 911446",
         "No. 12/4, East Mandara Main Road, Tulsipura Colony 911446", "No. 12/3, West Mandara Main Road, Tulsipura Colony 911446", "Tulsipura Colony", "Neelambur", "", None, "No. 12/3, East Mandara Main Road, Tulsipura Layout 911447"]
        + ["No. %d, East Mandara Main Road, Tulsipura Colony 911446" % k for k in range(100, 120)])]
    e = spark.createDataFrame([*many, many[0]], "entity_id long, entity_type string, text string").withColumn("id", F.lit(1))
    r = spark.createDataFrame([(7, "LOCATION", many[0][2]), (8, "LOCATION", many[1][2]), (9, "PERSON", many[1][2])], "resolved_id long, entity_type string, canonical string")
    got = {tuple(x) for x in addresses.found(e, r).collect()}
    assert got == {("entity", 0, 1), ("entity", 0, 2), ("entity", 1, 2), ("entity", 3, 4), ("resolved", 7, 8)}
    assert addresses.found(e.limit(0), r.limit(0)).count() == 0


def test_p4_beam_tolerates_two_edits_and_a_missing_side(spark):
    rows = [(k, "No. %d, East Chandrakala Main Road, Tulsipura Colony 911446" % k) for k in range(1, 101)]
    rows += [(1000 + k, "No. %d, East Mallige Lane, Tulsipura Colony 911446" % k) for k in range(1, 71)] + [(1100 + k, "No. %d, West Mallige Lane, Tulsipura Colony 911446" % k) for k in range(1, 71)]
    rows += [(2000, "No. 5, East Chandrekla Main Road, Tulsipura Colony 911446"), (2001, "# 6 E. Chxndrakaxa Mn Rd, Tulsipura Cly"),  # two edits off
             (2002, "No. 7, Chandrakala Main Road, Tulsipura Colony 911446"),  # the side is missing
             (2003, "No. 8, Mallige Lane, Tulsipura Colony 911446"),  # and here it may be either
             (2004, "No. 9, West Chandrakala Main Road, Tulsipura Colony 911446"), (2005, "No. 10, East Chandrakala Main Road, Tulsipura Clony 911446"), (2006, "12 911 446 Tulsipura Colony East Chandrakala Main Road")]
    e = spark.createDataFrame([(i, "LOCATION", t) for i, t in rows], "entity_id long, entity_type string, text string")
    r = spark.createDataFrame([], "resolved_id long, entity_type string, canonical string")
    assert {tuple(x)[1:] for x in addresses.found(e, r).collect()} == {(5, 2000), (6, 2001), (7, 2002), (10, 2005), (12, 2006)}
    got = {x.id: (x.place_id, x.records) for x in addresses.places(e, r).collect()}
    assert got[7] == got[2002] and got[7][1] == 2 and got[8][1] == got[2003][1] == got[2004][1] == 1


def test_p6_topic_valleys_are_chosen():
    rng = random.Random(61)
    farm, law = "wheat field plough seed barn harvest soil cattle".split(), "court judge appeal verdict statute counsel writ bench".split()
    say = lambda vocab: " ".join(rng.choice(vocab) for _ in range(7)).capitalize() + ". "
    for k in (5, 6, 7, 8):  # the topic changes after so many sentences; every sentence end is a natural boundary
        text = "".join(say(farm) for _ in range(k)) + "".join(say(law) for _ in range(30))
        change = next(m.start() for m in re.finditer(r"(?:Court|Judge|Appeal|Verdict|Statute|Counsel|Writ|Bench)", text))
        assert split.pieces(text)[0][1] in (change - 1, change), k


def test_p6_depths_against_their_definition():
    rng = random.Random(62)
    text = " ".join(rng.choice(["alpha", "beta", "gamma.", "delta.", "eps.\n"]) for _ in range(300))
    gaps = split._boundaries(text)
    got = split._depths(text, gaps, 9)
    from collections import Counter

    words = [(m.start(), m[0]) for m in re.finditer(r"\w+", text)]
    sims = []
    for p, _ in gaps:
        before, after = [w for q, w in words if q < p][-9:], [w for q, w in words if q >= p][:9]
        a, b = Counter(before), Counter(after)
        norm = (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
        sims.append(sum(v * b[w] for w, v in a.items()) / norm if norm else 0.0)
    for k, (p, _) in enumerate(gaps):
        peaks = 0.0
        for side in (sims[k::-1], sims[k:]):
            top = side[0]
            for x in side[1:]:
                if x < top:
                    break
                top = x
            peaks += top
        assert abs(got[p] - (peaks - 2 * sims[k])) < 1e-9


def test_p9_key_ranges_stay_small_whatever_the_weights():
    import math

    rng = random.Random(9)
    for weights in ([0.01], [0.05], [1.0], [0.01, 1.0]):
        keys = [-math.log(rng.random()) / rng.choice(weights) for _ in range(40_000)]
        from collections import Counter

        assert max(Counter(math.floor(math.log(k) * 512) for k in keys).values()) < 80  # 29 expected at most


def test_p6_pieces_are_lossless_and_bounded():
    rng = random.Random(6)
    words = ["पता", "house", "deed", "😀x", "survey", "vendor"]
    for n in (0, 1, 512, 513, 3000):
        for glue in (" ", ". ", "\n", "", ".\n\n"):
            text = "".join(itertools.islice((rng.choice(words) + glue for _ in itertools.count()), 2000))[:n]
            cuts = split.pieces(text)
            assert cuts[0][0] == 0 and cuts[-1][1] == len(text) and all(e - s <= 512 for s, e in cuts)
            for (s, e), (s2, e2) in zip(cuts, cuts[1:]):
                assert s < s2 <= e < e2 and e - s2 <= 50
                if glue.strip(" ") == "" and glue:
                    assert text[s2 - 1].isspace()
            assert (len(cuts) > 1) == (len(text) > 512)


def test_p6_items(spark):
    o = spark.createDataFrame([(1, "x" * 600, "f"), (2, None, "f"), (3, "y", "f")], "doc_id long, full_text string, text string")
    c = spark.createDataFrame([(4, ["a", None, "b " * 300]), (5, None), (6, [])], "doc_id long, paragraphs array<string>")
    assert {tuple(r) for r in split.found(o, c).collect()} == {(1, -1), (4, 2)}


def test_p8_against_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"t{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(30))) for k in range(12)] + [(50, "short item"), (51, None)]
    docs = []
    for k in range(60):
        w = [rng.choice(vocab) for _ in range(80)]
        i, n = rng.randrange(12), rng.choice([8, 11, 12, 13, 20])
        s = rng.randrange(0, 30 - n)
        w[20:20] = items[i][1].split()[s : s + n]
        docs.append((k, ", ".join(w).upper()))
    docs += [(100, None), (101, "")]
    tok = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    grams = lambda t: {tuple(tok(t)[k : k + 12]) for k in range(len(tok(t)) - 11)}
    want = {(d, i) for d, t in docs for i, x in items if grams(t) & grams(x)}
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(3))
    it = spark.createDataFrame(items, "item_id long, text string")
    assert want and {tuple(r) for r in leak.found(df.union(df.limit(2)), it).collect()} == want
    salted = leak.leaks(df, it, hot=2).filter("longest_run >= 12")
    assert {(r.doc_id, r.item_id) for r in salted.collect()} == want
    assert leak.found(df.limit(0), it).count() == 0 and leak.found(df, it.limit(0)).count() == 0


def test_p8_alignment_tolerates_edits():
    from lekhya.llm.hashing import flat_hashes

    h, off = flat_hashes([list("abcdefgh"), list("xxabcdzefghyy")])
    score, run = leak.align(h[off[1] : off[2]], h[off[0] : off[1]])
    assert score == 2 * 8 - 1 and run == 4


def test_p8_alignment_of_many_pairs_against_plain_dynamic_programming():
    import numpy as np

    rng = random.Random(82)
    pairs = [([rng.randrange(9, 14) for _ in range(rng.randint(0, 30))], [rng.randrange(9, 14) for _ in range(rng.randint(1, 20))]) for _ in range(60)]
    want = []
    for d, w in pairs:
        h, run = ([[0] * (len(d) + 1) for _ in range(len(w) + 1)] for _ in range(2))
        for i, x in enumerate(w, 1):
            for j, y in enumerate(d, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
                run[i][j] = run[i - 1][j - 1] + 1 if x == y else 0
        want.append((max(map(max, h)), max(map(max, run))))
    arrays = [(np.array(d, dtype=np.uint64), np.array(w, dtype=np.uint64)) for d, w in pairs]
    assert [tuple(map(int, x)) for x in zip(*leak.align_all(*map(list, zip(*arrays))))] == want == [leak.align(*a) for a in arrays]


def test_p8_pairs_of_edited_copies(spark):
    rng = random.Random(81)
    words = [[f"i{k}w{j}" for j in range(30)] for k in range(4)]
    items = [(k, " ".join(w)) for k, w in enumerate(words)] + [(8, "three word item"), (9, " ... ")]
    docs = []
    for k, w in enumerate(words):  # every sixth word changed: runs of five words are left
        docs.append((k, " ".join(["before"] * 5 + [x if j % 6 != 5 else f"new{rng.randrange(99)}" for j, x in enumerate(w)] + ["after"] * 5)))
    docs += [(10, "here a Three-word item ends"), (11, "three item word"), (12, " ".join(words[0][3:8])), (13, " ".join(words[0][3:7])), (14, "one three word"), (15, "item")]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(0, 0), (1, 1), (2, 2), (3, 3), (10, 8)}
    got = {(r.doc_id, r.item_id): r for r in leak.leaks(df, it).collect()}
    assert set(got) == want  # five words (12) are no copy of an item of thirty
    assert {(r.doc_id, r.item_id) for r in leak.leaks(df, it, least=10, hot=1).collect()} == want | {(12, 0)}
    assert all(got[k, k].longest_run == 5 and got[k, k].coverage > 0.6 for k in range(4)) and got[10, 8].coverage == 1.0
    assert leak.found(df, it).count() == 0


def test_p8_recall_of_planted_edited_copies(spark):
    rng = random.Random(83)
    vocab = [f"v{k}" for k in range(400)]
    stock = "in witness whereof the parties have set their hands".split()  # every item and document holds it: hot n-grams
    items = [(k, [rng.choice(vocab) for _ in range(25)] + stock + [rng.choice(vocab) for _ in range(25)]) for k in range(10)]
    docs, want = [], set()
    for k in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randrange(50, 400))]
        if k % 2:
            i = rng.randrange(10)
            copy, edits = [], rng.sample(range(59), 6)  # one word in ten replaced, left out or doubled
            for j, x in enumerate(items[i][1]):
                copy += {0: [x], 1: [rng.choice(vocab)], 2: [], 3: [x, x]}[1 + rng.randrange(3) if j in edits else 0]
            at = rng.randrange(len(w))
            w[at:at] = copy
            want.add((k, i))
        docs.append((k, " ".join(w + stock)))
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    for hot in (20_000, 7):
        got = {(r.doc_id, r.item_id) for r in leak.leaks(df, it, hot=hot).filter("coverage >= 0.5").collect()}
        assert len(got & want) >= 0.95 * len(want) and len(got - want) == 0


def test_p9_shares_and_caps(spark):
    rng = random.Random(9)
    rows = [(k, "big", " ".join(rng.choices(["deed", "house", "sale"], k=rng.randint(5, 60))), rng.random()) for k in range(400)]
    rows += [(1000 + k, "small", "survey number " * 20, None) for k in range(10)] + [(2000, None, "x", 1.0), (2001, "other", "x", 1.0), (2002, "big", None, 1.0), (2003, "big", "  ", 1.0)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string, ocr_confidence double").withColumn("tokens", F.lit("clash"))
    t = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("none", 0.0, 1), ("empty", 0.1, 2)], "source string, target_share double, max_repeats int")
    got = {r.source: r for r in mix.shares(d, t).collect()}
    total = got["big"].tokens + got["small"].tokens
    assert abs(got["small"].tokens / total - 0.4) < 0.02 and got["small"].most_times <= 3 and got["big"].most_times == 1 and got["empty"].tokens == 0
    one = {(r.doc_id, r.times) for r in mix.mix(d, t, total=2000).collect()}
    assert one == {(r.doc_id, r.times) for r in mix.mix(d.repartition(7), t, total=2000, buckets=4).collect()}
    assert mix.mix(d.limit(0), t).count() == 0 and mix.mix(d, t.limit(0)).count() == 0


def test_p10_cases(spark):
    yes = ["GIFT DEED <%= x.y %>", "paid {{ stamp_duty }} today", "to [purchaserAddress] now", "404 - Not Found\nx", "Please enable JavaScript to view this", "Lorem ipsum dolor sit amet consectetur elit", "TODO: confirm with client.", "NaN sq.ft.",
           "__name of transferee__ pays", "undefined son of null,", "on XX-XX-XXXX, Rs. XXXXX/-", "कृपया यह दस्तावेज़ देखने के लिए जावास्क्रिप्ट चालू करें।", "Your session has expired. Log in again", "%%khata_no%%", "by [● ] or [●]", "<DD/MM/YYYY>"]
    no = ["The words [sic] and [L.S.] appear in the older draft.", "Sd/- ____________ Attestor", "The leaf was not found in Book 56; a blank space was struck through thus: ________.",
          "Counsel recorded that the portal wanted scripts and cookies before it showed the index.", "Sites (A) and [B] on the plan are excluded.", "An error in page six of the former deed is set right.", "at 22:38 [Asia/Kolkata] by the clerk",
          "Since the server of the registry was down the parties were told to return.", "Both parties used the society's template wording.", "null and void", "", None, "No. 404/4, East Road, 500 sq ft"]
    docs = [(k, t) for k, t in enumerate(yes)] + [(100 + k, t) for k, t in enumerate(no)]
    df = spark.createDataFrame([(i, "sale_deed_1.pdf", t, "host") for i, t in docs], "doc_id long, doc_name string, text string, source string").withColumn("kinds", F.lit(1))
    got = {r.doc_id for r in residue.found(df.union(df.limit(2))).collect()}
    assert got == set(range(len(yes)))
    assert residue.found(df.limit(0)).count() == 0


def test_p10_whole_responses_of_unseen_wording_by_host_evidence(spark):
    rng = random.Random(10)
    names = ["Asha Rao", "Ravi Iyer", "Meena Das", "Kiran Bhat", "Lata Nair", "Dev Joshi"]

    def deed(k):
        parts = [f"Sale Deed\nThis deed of sale is made on {rng.randint(1, 28)}-0{rng.randint(1, 9)}-2011 between {rng.choice(names)} and {rng.choice(names)} of Plot {rng.randint(1, 999)}"]
        parts += [f"the seller conveys the land of {rng.randint(10, 99)} acres to {rng.choice(names)} for Rs {rng.randint(1000, 9999)} under deed {rng.randint(1, 999)}" for _ in range(5)]
        return ". ".join(parts)

    docs = [(k, f"sale_deed_{k}.pdf", deed(k), f"h{k % 4}") for k in range(400)]
    docs += [(1000 + k, f"scan_{k}.pdf", docs[7][2], "h1") for k in range(60)]  # copies of one deed: repeated, but full of content
    short = "The vault viewer naps. Come back once somebody has woken it. Ticket %d"
    long = "Nothing is shown. " + " ".join("Our keepers regret that nobody could find whatever you wished for, so kindly wander elsewhere." for _ in range(40)) + " Ticket %d"
    docs += [(2000 + k, "gift_deed_3.pdf", short % k, "h2") for k in range(3)]  # three copies on one host
    docs += [(2100 + k, f"will_{k}.pdf", long % k, f"h{k % 3}") for k in range(6)]  # long pages, two on each of three hosts
    docs += [(2200, "sale_deed_9.pdf", "Kindly whistle twice and wait.", "h0"), (2201, None, "Kindly hum", None)]  # strange, but seen once
    df = spark.createDataFrame(docs, "doc_id long, doc_name string, text string, source string")
    got = {r.doc_id: r for r in residue.score_documents(df).collect()}
    assert set(got) == {2000, 2001, 2002, *range(2100, 2106)}
    assert all(r.kinds == ["duplicated"] for r in got.values()) and got[2000].host_copies == 3


def test_p10_fields_of_unseen_names():
    for t in ("paid on {0} and {1}", "Press or tap here to enter the seller's age", "(NAME OF WITNESS TO BE TYPED)", "signed at {{ anyNewField7 }}", "of $" + "{a.b}", "living at __where_they_live__"):
        assert residue.evidence(t), t
    for t in ("A sum is to be settled within 9 days (to be paid to the vendor).", "from here on called the VENDOR", "the survey (No. 3) is to be filled by hand"):
        assert not residue.evidence(t), t


def test_p10_anchors_are_as_case_blind_as_their_patterns():
    texts = ["503 Service Unavailable", "Service Is Temporarily UNAVAILABLE", "ACCESS DENIED", "Something Went Wrong", "Your session has Expired", "DUMMY TEXT", "(Delete as applicable)", "(Fill in date)", "(Tick)", "http 404",
             "Error Code 404", "FATAL ERROR", "Segmentation Fault", "KeyError at line 3", "Please enable JS", "Enable Script", "on xx/xx/xx", "Is under scheduled Maintenance", "The record you are looking for", "You do not have permission.",
             "429 Too Many Requests", "Click here to add", "TEST TEST", "Please Try Again Later", "Text Goes Here", "NEEDS COOKIES in the browser"]
    for t in texts:
        plain = {kind for kind, _, pattern in residue.DETECTORS if pattern.search(t)}
        for v in (t, t.upper(), t.lower(), t.title()):
            assert set(residue.evidence(v)) >= {kind for kind, _, pattern in residue.DETECTORS if pattern.search(v)}, v
        assert plain, t
    assert all(a == a.lower() for (_, anchors, _), blind in zip(residue.DETECTORS, residue._CASE_BLIND) if blind for a in anchors)


def test_p4_no_side_that_grows_with_the_records_is_broadcast(spark, monkeypatch):
    e = spark.createDataFrame(
        [(k, "LOCATION", f"No. {k % 7 + 1}, {n} Street, Ashok Nagar, 911 010") for k, n in enumerate(["Kamala", "Kamla", "Vimala"] * 8)], "entity_id long, entity_type string, text string"
    )
    r = spark.createDataFrame([(1, "LOCATION", "No. 1, Kamala Street, Ashok Nagar, 911 010")], "resolved_id long, entity_type string, canonical string")
    plans, write = [], addresses.materialise
    monkeypatch.setattr(addresses, "materialise", lambda df, label: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, label))[1])
    out = addresses.found(e, r)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not [p for p in plans if "BroadcastHashJoin" in p or "BroadcastExchange" in p]
    assert out.count() > 0


def test_p2_lexicon_loses_no_word_and_no_pair(spark, monkeypatch):
    rows = [(f"word{k}", 100 - k, k % 2 * 100) for k in range(40)] + [(f"word{k} mot\u00e9{k % 7}", 6 + k % 5, 0) for k in range(40)] + [("rare", 2, 0), ("rare pair", 5, 0)]
    counted = spark.createDataFrame(rows, "w string, n long, capital long")
    whole = ocr_repair.lexicon_of(counted)
    monkeypatch.setattr(ocr_repair, "MAX_WORDS", 3, raising=False)
    monkeypatch.setattr(ocr_repair, "MAX_PAIRS", 4)
    small = ocr_repair.Lexicon(*ocr_repair._plain(ocr_repair.lexicon_of(counted)))
    assert small.words == whole.words == {w: n for w, n, _ in rows if n > 2 and " " not in w} and small.names == whole.names
    assert len(small.pairs) == 4 and len(whole.pairs) == 40
    for w, n, _ in rows[40:-2]:
        assert small.pair(*w.split(" ")) == whole.pair(*w.split(" ")) == n
    assert small.pair("rare", "pair") == small.pair("word1", "word2") == whole.pair("word1", "word2") == 0
    assert small.candidates("word1") == whole.candidates("word1") and small.correction("wordl") == whole.correction("wordl")
