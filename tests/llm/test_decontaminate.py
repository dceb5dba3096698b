import re

from hornbeam.llm.decontaminate import contaminated, found_in, unchecked_items

ITEM = b"Alice has 12 apples and gives 5 to Bob, who then eats 12 of the 7 kg he bought; how many are left?"


def found(text, items=((1, ITEM),)):
    return [items[f[1]][0] for f in found_in([x for _, x in items], [text.encode()])]


def test_reparameterised_questions():
    assert found("so: Maria has 31 apples and gives 9 to Tom, who then eats 31 of the 44 lbs he bought; how many are left? ok") == [1]
    assert found("ALICE HAS 12 APPLES AND GIVES 5 TO BOB, WHO THEN EATS 12 OF THE 7 KG HE BOUGHT; HOW MANY ARE LEFT?") == [1]
    assert found("Alice has 3.5 apples and gives twenty five to Bob, who then eats 3.5 of the 7 kg he bought; how many are left?") == [1]


def test_inconsistent_slots_are_other_questions():
    assert found("Maria has 31 apples and gives 9 to Tom, who then eats 30 of the 44 lbs he bought; how many are left?") == []


def test_clean_text_stays():
    for t in ["", " ", "1 2 3 4 5 6 7 8 9 10 11 12 13 14", "Alice has apples and gives them to Bob", "one kg two kg three kg four kg five kg six kg seven kg"]:
        assert found(t) == []


def test_short_items_and_cut_copies():
    assert found("they said what is the capital of france today", [(5, b"What is the capital of France?")]) == [5]
    assert found("a b c d", [(6, b"a b c d")]) == []
    words = " ".join(f"term{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
    assert found(" ".join(words.split()[5:30]), [(7, words.encode())]) == [7]
    assert found(" ".join(words.split()[5:14]), [(7, words.encode())]) == []


def test_matches_plain_search(spark):
    import re

    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    norm = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = [(r["item_id"], norm(r["text"])) for r in bench.collect()]
    want = {(r["doc_id"], i) for r in docs.collect() for i, t in items if t in norm(r["text"])}
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(spark, docs, bench).collect()} == want and want


def test_blocks_and_odd_rows(spark, odd, none, odd_rows, monkeypatch):
    from hornbeam.llm import decontaminate

    from .conftest import SENTENCE

    bench = spark.createDataFrame([(1, SENTENCE), (2, None), (None, "x"), (3, "so very different words that nobody wrote in any of these rows")], "item_id long, text string")
    want = sorted([r[0] for r in odd_rows if r[1] and SENTENCE in r[1].lower()], key=repr)
    assert sorted([r["doc_id"] for r in contaminated(spark, odd, bench).collect()], key=repr) == want
    monkeypatch.setattr(decontaminate, "LEAST_BITS", 1 << 13)
    monkeypatch.setattr(decontaminate, "MOST_BITS", 1 << 13)
    assert sorted([r["doc_id"] for r in contaminated(spark, odd, bench).collect()], key=repr) == want
    assert sorted(r["item_id"] or 0 for r in unchecked_items(spark, bench).collect()) == [0, 2]
    assert contaminated(spark, none, bench).count() == 0 and contaminated(spark, odd, bench.limit(0)).count() == 0


def test_verbatim_copies_with_few_literals():
    for item in ("What is 15 + 27 - 8?", "What is 12 plus 30 minus 4?", "2 4 8 16 32 64 128 256 512 1024 2048 4096", "Alice, Bob and Tom: 3 kg, 4 kg, 5 kg, 6 kg or 7 kg?", "Paris or Rome"):
        one = [(3, item.encode())]
        assert found(f"see 12. {item} 34 is the answer", one) == [3], item
        assert found(f"so \u201c{item.upper()}\u201d they said", one) == [3], item
    assert found("What is 16 + 27 - 8?", [(3, b"What is 15 + 27 - 8?")]) == []


def test_scripts_without_spaces():
    for item in ("中国的首都是哪里？", "日本の首都はどこですか", "เมืองหลวงของไทย", "首都"):
        one = [(4, item.encode())]
        assert found(f"他问：{item}然后走了。", one) == [4], item
    assert found("英国的首都是伦敦", [(4, "中国的首都是哪里？".encode())]) == []


NUMBER, UNIT, PERSON = ("number",), ("unit",), ("person",)


def template(text):
    """Typed tokens of plain English by regular expressions: (template token, value)."""
    out = []
    for m in re.finditer(r"[0-9]+(?:[.,][0-9]+)*|[A-Za-z]+", text):
        w = m[0]
        start = not re.search(r"[^\W_]", text[: m.start()]) or re.search(r"[.!?:\n\"'(]\W*$", text[: m.start()])
        if w[0].isdigit():
            out.append((NUMBER, w))
        elif w.lower() in ("kg", "lbs", "km", "miles", "hours", "minutes"):
            out.append((UNIT, w.lower()))
        elif w[0].isupper() and len(w) > 1 and not start or w in ("Alice", "Bob", "Maria", "Tom", "Anna"):
            out.append((PERSON, w.lower()))
        else:
            out.append((w.lower(), w.lower()))
    return out


def same_question(item, text):
    """Brute force: the whole item's template at some place of the text, with one value for each of the item's values."""
    a, b = template(item), template(text)
    for i in range(len(b) - len(a) + 1):
        if all(x[0] == y[0] for x, y in zip(a, b[i:])):
            slots: dict = {}
            if all(slots.setdefault(x, y[1]) == y[1] for x, y in zip(a, b[i:]) if not isinstance(x[0], str)):
                return True
    return False


def test_template_matches_against_brute_force(spark):
    """Documents made of questions with other values, consistent or not, among prose: the operator finds what the brute force finds."""
    import random

    r = random.Random(4)
    shapes = [
        "{p} rode {a} km in {b} hours and {q} rode {a} km in {c} hours so who of the two was faster on the road",
        "If {p} buys {a} kg of flour and {q} buys {b} kg of sugar what do they carry home after {p} eats {a} grains",
        "A farmer told {p} that {a} goats eat {b} bales while {c} sheep eat {d} bales every single winter on the hill",
    ]
    people = ["Alice", "Bob", "Maria", "Tom", "Anna"]

    def fill(shape, broken=False):
        p, q = r.sample(people, 2)
        a, b, c, d = r.sample(range(2, 99), 4)
        text = shape.format(p=p, q=q, a=a, b=b, c=c, d=d)
        if broken and f" {a} " in text[text.index(f" {a} ") + 3 :]:
            cut = text.index(f" {a} ") + 3
            text = text[:cut] + text[cut:].replace(f" {a} ", f" {a + 1} ", 1)
        return text

    items = [(k, fill(s)) for k, s in enumerate(shapes)]
    prose = "over the old stone bridge walked a slow line of carts and dogs while rain fell on the quiet fields below"
    docs = [(i, f"{prose} {fill(r.choice(shapes), r.random() < 0.4) if i % 3 else prose} {prose}") for i in range(200)]
    want = {(i, k) for i, t in docs for k, s in items if same_question(s, t)}
    # An inconsistent copy may still share a long verbatim stretch; such pairs are no matter of templates.
    got = {(x["doc_id"], x["item_id"]) for x in contaminated(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert want <= got and len(want) > 40
    extra = got - want
    assert all(len(set(dict(docs)[i].split()) & set(dict(items)[k].split())) > 10 for i, k in extra) and len(extra) < 0.4 * len(got)
