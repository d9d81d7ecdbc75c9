"""Story scan: golden texts, code that must not come out, nesting, long input."""

import time

import pytest

from lexloom.sources import stories as S

STORY = """<html><tw-storydata name="T" format="{format}" hidden><tw-passagedata pid="1" name="Begin &amp; go" tags="">You rise at dawn.
<<set $coins to 7>>
[[Walk on|wood]]
You take <<$thing>> from the table.
Time: <<set $t to new Date()>> runs.
Coins: $coins.
<script>
window.X = 1; not text
</script>
after script</tw-passagedata><tw-passagedata pid="2" name="wood"
  tags="">&lt;b&gt;All is dark.&lt;/b&gt;
Ask: <<= either('First words', "Second words")>> and <<= split('x y', ' ')>>
[[Stop!|wood][$a to 1, $b
to true] ]
&lt;&lt;set $m = {{
inner: 0,
}}&gt;&gt;
Text after it.</tw-passagedata><tw-passagedata pid="3" name="W" tags="noshow widget">hidden widget text</tw-passagedata><tw-passagedata pid="4" name="StoryInit" tags="">hidden init</tw-passagedata><tw-passagedata pid="5" name="Forms" tags="x">/* a comment */
[[Back home->Home]]
[[Home<-Go back]]
[img[Pic|pic.png][Home][$done to true]]
[[Shop][$b to "milk"]]
$thing["name"] is here
$a['p'] and $b.p.
Joined line \\
goes on.
<<link "Open gate" "Gate">> <<goto "Begin">> <<radio "Choose" "$c">> <<PRINT "one" 'two'>> <<prompt "Ask" "$a" "no">> <<button "has <<if>> code">>
a <b unclosed and << "quoted >> still" open</tw-passagedata></tw-storydata></html>"""


@pytest.fixture(scope="module")
def found(spark):
    files = [("s.html", STORY.format(format="SugarCube")), ("none.html", "<p>no story</p>"), ("null.html", None)]
    return S.story_entries(spark.createDataFrame(files, "file string, html string")).orderBy("ord", "line", "seg", "arg").collect()


def test_story_texts(found):
    assert [r["original"] for r in found] == ["You rise at dawn.", "Walk on", "You take", "from the table.", "Time:", "runs.", "Coins:", "after script", "All is dark.", "Ask:", "First words", "Second words", "and", "Text after it.", "Back home", "Go back", "is here", "and", "goes on.", "Open gate", "Choose", "one", "two", "Ask", "a", '> still" open']
    paths = {r["original"]: r["json_path"] for r in found}
    assert paths["from the table."] == "passage[1].line[3].seg[2]"
    assert paths["Second words"] == "passage[2].line[1].seg[1].arg[1]"
    assert found[0]["context"] == "Begin & go (pid 1)" and {r["file"] for r in found} == {"s.html"}


def test_calls_and_arrows(spark):
    body = 'A cat is seen.\nOpen (link: "the door")[(goto: "Door")].\nHere (image: "a ) b.png").\n(if: $x > 3)[Too many.]\n[go home->Home]\n(link-goto: "Run", "Wood")\n(broken: "no end'
    html = f'<tw-storydata format=" Harlowe"><tw-passagedata pid="1" name="P" tags="">{body}</tw-passagedata>'
    rows = S.story_entries(spark.createDataFrame([("h", html)], "file string, html string")).orderBy("line", "seg").collect()
    # The hook around a call is cut at its bracket.
    assert [r["original"] for r in rows] == ["A cat is seen.", "Open", "Here", "[Too many.]"]


def test_segments_cover_the_line():
    lines = ["a <<b>> c [[d|e]] $f.g <h>i</h> [img[j]] k", "<<x \"a >> b\" 'c\\'>>'>>t", "no [[end", "$ 5 < 6 <", "[img[x", "<b", ">> x", "a<<", "", "$a[$b][1]x"]
    for line in lines + ["(if: (either: 1, ')'))[x] (a", "[x] [y->z] [", "(a:"]:
        for harlowe in (False, True):
            got = S.segments(line, harlowe)
            assert "".join(s.raw for s in got) == line
            assert [s.start for s in got] == [sum(len(x.raw) for x in got[:k]) for k in range(len(got))]
    assert [s.kind for s in S.segments(lines[0])] == ["text", "macro", "text", "link", "text", "var", "text", "tag", "text", "tag", "text", "img", "text"]
    assert [s.raw for s in S.segments(lines[1])] == ["<<x \"a >> b\" 'c\\'>>'>>", "t"]
    assert [(s.kind, s.raw) for s in S.segments("a <b c")] == [("text", "a "), ("text", "<b c")]


def test_masks_of_stories():
    assert S.mask_story_codes("Go [[on|p]] <b>$x.y</b> [[q]] [[r<-s]]") == ("Go [[on|<x0/>]] <x3/><x4/><x5/> <x1/> [[<x2/><-s]]", ["p", "[[q]]", "r", "<b>", "$x.y", "</b>"])
    assert S.mask_story_codes('See (image: "a)") [x->y] $z', True) == ("See <x0/> <x1/> <x2/>", ['(image: "a)")', "[x->y]", "$z"])
    assert S.mask_story_codes("plain") == ("plain", [])


def test_a_megabyte_without_ends(spark):
    n = 1_000_000
    bodies = ["<<" + "a\"b'" * (n // 4), "(a:" * (n // 3), "[[" + "x" * n, "<" * n, "$a" * (n // 2), "[" * n, "<<x " + '"' * n, "<<" * (n // 2)]
    files = [(str(k), f'<tw-storydata format="Harlowe"><tw-passagedata pid="1" name="P" tags="">{b}\nlast words</tw-passagedata>') for k, b in enumerate(bodies)]
    began = time.time()
    rows = S.story_entries(spark.createDataFrame(files, "file string, html string").repartition(4)).where("original = 'last words'").collect()
    assert len(rows) >= 1 and time.time() - began < 60


def test_model(spark):
    files = spark.createDataFrame([("s", STORY.format(format="SugarCube"))], "file string, html string")
    [row] = S.story_model(S.story_passages(files)).collect()
    assert [p["pid"] for p in row["passages"]] == ["1", "2", "3", "4", "5"]
    first = row["passages"][0]["segments"]
    assert [(s["type"], s["translatable"]) for s in first[:3]] == [("text", ["You rise at dawn."]), ("macro", []), ("link", ["Walk on"])]
