import hashlib

import duckdb
import pytest

from patchloom.llm.chat import OP11_SQL, TEMPLATE, TRIAL, Const, Emit, If, Template, TemplateError, escape, fold_body, format_conversations, line, op11_chat_template, parse, read_back, unescape, unline

SCHEMA = "conv_id long, turn long, role string, text string, part string, formatted string, loss long"
NASTY = ["", "<|im_end|>", "<\\|x", "<\\\\\\|y<|", "a\\nb\n\\", "<", "|>", TRIAL, "{{ x }}{% if %}", "é🎉 \r\n", "<|im_start|>assistant\n"]


def rendered(source, messages=(), **more):
    pieces = list(Template(source).render(messages, **more))
    return "".join(p[1] for p in pieces)


def test_escaping_is_reversible():
    for a in NASTY:
        for b in NASTY:
            assert unescape(escape(a + b)) == a + b and "<|" not in escape(a + b)
            assert unline(line(a + b)) == a + b and "\n" not in line(a + b)


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("a{# no {{ x }} #}b", "ab"),
        ("{{ 'it\\'s' ~ 1 + 2 }}", "it's3"),
        ("{% for m in messages %}{{ loop.index }}{{ m.role }}{{ m['text'] | upper }}{% if not loop.last %},{% endif %}{% endfor %}", "1uX,2vY"),
        ("x \n {{- 'y' -}} \n z", "xyz"),
        ("{% set n = messages | length %}{% if n == 2 and 'u' in messages[0].role %}two{% elif n > 2 %}many{% else %}few{% endif %}", "two"),
        ("{{ nothing | default('d') }}{{ nothing.at.all }}{{ messages[9] }}", "d"),
        ("{% for a in messages %}{% for b in messages %}{{ a.role ~ b.role }} {% endfor %}{% endfor %}", "uu uv vu vv "),
        ("{% for x in messages %}{% set k = 1 %}{% endfor %}{{ k }}", ""),
        ("{{ 'a' if false else 'b' }}{{ true }}{{ none }}{{ not 0 }}{{ 1 not in messages }}{{ -3 }}", "btruetruetrue-3"),
    ],
)
def test_language(source, want):
    assert rendered(source, [{"role": "u", "text": "x"}, {"role": "v", "text": "y"}]) == want


@pytest.mark.parametrize("source", ["{% for x in y %}", "{{ x", "{{ }}", "{% what %}", "{{ x.y() }}", "{{ x | no }}", "{{ x | upper(1) }}", "{% if x %}{% else %}{% elif y %}{% endif %}", "{% endif %}", "{{ 1 2 }}", "{{ " + "(" * 99 + "1" + ")" * 99 + " }}", "{% if a %}" * 99, "{{ x.1 }}", "{% endfor x %}", "{{ f('x') }}"])
def test_faults_are_found_before_rendering(source):
    if source == "{{ x":
        assert rendered(source) == source  # an open bracket is text
        return
    with pytest.raises(TemplateError):
        Template(source)


def test_sandbox():
    class Host:
        secret = "s"

    for source in ("{{ h.secret }}", "{{ h.__class__ }}", "{{ 'a'.upper }}", "{{ 'a' + 1 }}", "{{ 'a' < 1 }}", "{% for x in 'abc' %}{% endfor %}", "{{ h }}"):
        with pytest.raises(TemplateError):
            rendered(source, h=Host())
    with pytest.raises(TemplateError):
        rendered("{% set x = 'aaaaaaaa' %}" + "{% set x = x ~ x %}" * 40)


def test_constants_are_folded():
    assert fold_body(parse("a{{ 'b' ~ 1 + 1 }}{% if 1 == 2 %}c{{ x }}{% elif true %}d{% else %}e{% endif %}{{ 'F' | lower }}")) == (Emit(Const("ab2df")),)
    tree = fold_body(parse("{% if x %}a{{ 'b' }}{% elif false %}{{ y }}{% elif 1 %}c{% else %}d{% endif %}"))
    assert tree[0] == If(((tree[0].branches[0][0], (Emit(Const("ab")),)), (Const(True), (Emit(Const("c")),))))
    with pytest.raises(TemplateError):  # a faulty constant fails where it is reached, and only there
        rendered("{{ 1 + 'a' }}")
    assert rendered("{% if x %}{{ 1 + 'a' }}{% endif %}ok") == "ok"


def test_generation_spans_and_pieces():
    messages = [{"role": "assistant" if k % 3 else "user", "text": t} for k, t in enumerate(NASTY * 3)]
    whole = list(Template(TEMPLATE).render(iter(messages)))
    assert len(whole) == 1 and Template(TEMPLATE).single
    for piece in (1, 40, 200):
        parts = list(Template(TEMPLATE).render(iter(messages), piece))
        assert "".join(p[1] for p in parts) == whole[0][1] and sum((p[2] for p in parts), []) == whole[0][2]
        assert [p[0] for p in parts] == [sum(len(q[1]) for q in parts[:k]) for k in range(len(parts))]
    text = whole[0][1]
    assert [unescape(text[a:b]) for a, b in whole[0][2]] == [m["text"] for m in messages if m["role"] == "assistant" and m["text"]]
    nested = list(Template("{% generation %}a{% generation %}b{% endgeneration %}{% endgeneration %}{% generation %}{% endgeneration %}").render([]))
    assert nested == [(0, "ab", [(0, 2)])]


def slow(rows):
    """The digest by plain Python, with no template."""
    out = {}
    for i in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == i), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
        own = [(r[2] or "", r[3] or "") for r in own]
        said = "".join(t for a, t in own if a == "assistant")
        full = "".join(f"<|im_start|>{escape(line(a))}\n{escape(t)}<|im_end|>\n" for a, t in own)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[i] = (i, len(own), sha("".join(f"{a}\n{t}\n" for a, t in own)), len(said), sha(said), len(full))
    return out


@pytest.mark.parametrize("piece", [1 << 20, 30])
def test_odd_rows(spark, piece):
    rows = [(k % 4, k, ["user", "assistant", None, "assistant", "sys\\tem\n<|x|>"][k % 5], NASTY[k % len(NASTY)] * (k % 3 + 1) if k % 7 else None) for k in range(200)]
    rows += [(None, 1, "assistant", "x"), (None, None, "user", "y"), (9, 1, "assistant", "same")] + [(9, 1, "assistant", "same")] * 3 + [(10, 0, None, None), (11, 5, "assistant", "w " * 300_000)]
    df = spark.createDataFrame([(*r, "p", "f", 1) for r in rows], SCHEMA).repartition(3)
    got = {r.conv_id: tuple(r) for r in read_back(format_conversations(df, piece=piece)).collect()}
    assert got == slow(rows)
    if piece == 30:
        assert format_conversations(df, piece=piece).where("part > 0").count() > 50


def test_other_columns_and_templates(spark):
    df = spark.createDataFrame([("c", 2.5, "b", "t"), ("c", 1.5, "a", "s")], "c string, t double, r string, x string")
    got = format_conversations(df, "{{ messages | length }}{% for m in messages %}{{ m.role }}{% endfor %}", "c", "t", "r", "x").collect()
    assert [(r.conv_id, r.formatted, r.loss) for r in got] == [("c", "2ab", [])]
    assert format_conversations(df.limit(0), conv_col="c", turn_col="t", role_col="r", text_col="x").collect() == []
    with pytest.raises(TemplateError):
        format_conversations(df, "{% for %}")


def test_query(spark, data_dir):
    got = sorted(map(tuple, op11_chat_template(spark, data_dir).collect()))
    rows = [tuple(r) for r in spark.read.parquet(f"{data_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == sorted(slow([*rows, (-1, 0, "user", TRIAL), (-1, 1, "assistant", TRIAL)]).values())
    with duckdb.connect() as con:
        con.sql(f"create view conversations as select * from '{data_dir}/conversations.parquet'")
        assert sorted(con.sql(OP11_SQL).fetchall()) == got
