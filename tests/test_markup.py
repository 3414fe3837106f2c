import pytest

from lexiloom.sources import markup, provenance

FILE = """#=IVTFF Toy- 1.5.2 D
# made up

<p7>      <! $Q=C $P=b $I=Z $L=B $H=5>
<p7.1,@P0>       <%>mola.ti.renu<$>
<p7.2,+P0;K>       gus.fe,lo,vim~<~>pax
<p7.3,+Lt>       mi[r:s]o.{bl}un.zo@207;e.ka?.??
<p7.4,+P0>       tre.que/
/mo.sal/
/.fin
<q1v>      <! $H=@ $Q=D>
<q1v.1,@P0>       solo
<q1v.2,+P0>       <@H=8>nix.vel
"""


def files(spark, *texts):
    return spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "file string, text string")


def test_file_is_parsed(spark):
    parts = markup.ingest(files(spark, FILE))
    assert tuple(parts["header"].first())[1:] == ("Toy-", "1.5.2", "D") and parts["errors"].count() == 0
    pages = {r["name"]: r for r in parts["pages"].collect()}
    assert pages["p7"]["seq"] == 0 and pages["q1v"]["seq"] == 1 and pages["q1v"]["hand"] is None and pages["p7"]["illustration_type"] == "Z"
    loci = {(r["page"], r["num"]): r for r in parts["loci"].collect()}
    assert loci["p7", 4]["raw_text"] == "tre.quemo.sal.fin" and loci["p7", 2]["transcriber"] == "K"
    assert loci["p7", 1]["par_start"] and loci["p7", 1]["par_end"] and loci["q1v", 2]["hand"] == "8" and loci["q1v", 1]["hand"] is None and loci["p7", 3]["hand"] == "5"
    tokens = {(r["page"], r["num"], r["position"]): r for r in parts["tokens"].collect()}
    assert [tokens["p7", 2, k]["form"] for k in range(5)] == ["gus", "fe", "lo", "vim~", "pax"]
    assert [tokens["p7", 2, k]["sep_before"] for k in range(5)] == [None, ".", ",", ",", "~"]
    third = [tokens["p7", 3, k] for k in range(5)]
    assert [t["form"] for t in third] == ["miro", "blun", "zo@207;e", "ka?", "??"]
    assert third[0]["has_alternative"] and third[1]["has_ligature"] and third[2]["has_high_ascii"] and third[3]["has_unreadable"] and third[2]["glyph_count"] == 4


@pytest.mark.parametrize(
    "text,line,message",
    [
        ("anything\n<k2> x", 1, "the first line is no file header"),
        ("#=IVTFF Toy- 1.0 A\n<k2.1,@P0> u", 2, "a locus outside of any page"),
        ("#=IVTFF Toy- 1.0 A\n<k2>\n<k3.1,@P0> u", 3, "the locus is of another page"),
        ("#=IVTFF Toy- 1.0 A\n<k2>\n/u", 3, "a continuation with nothing to continue"),
        ("#=IVTFF Toy- 1.0 A\n<k2>\n<k2.1,@P0> u/\n<k2.2,@P0> v", 3, "the wrapped line is never continued"),
        ("#=IVTFF Toy- 1.0 A\nnothing known", 2, "neither a header, a locus, a comment nor a continuation"),
        ("#=IVTFF Toy- 1.0 A\n<k.l> u", 2, "no known form of header or locus"),
    ],
)
def test_faults(spark, text, line, message):
    assert [(r["line"], r["message"]) for r in markup.parse(files(spark, text))["errors"].collect()] == [(line, message)]


def test_tokenizer_cases():
    forms = lambda raw, comma=True: [t["form"] for t in markup.tokenize(raw, comma)[0]]
    assert forms("mola.ti.renu.ti") == ["mola", "ti", "renu", "ti"]
    assert forms("gus,fe.lo,vim") == ["gus", "fe", "lo", "vim"] and forms("gus,fe.lo,vim", False) == ["gusfe", "lovim"]
    assert [t["sep_before"] for t in markup.tokenize("pax<~>nix,vel<->solo")[0]] == [None, "~", ",", "-"]
    token = markup.tokenize("so[l{ab}:m:n]ne.u")[0][0]
    assert token["form"] == "solabne" and token["has_alternative"] and token["has_ligature"] and not token["has_unreadable"]
    assert markup.tokenize("<@K=1>u<%><!why>v<@K=2><$>")[1:] == (True, True, {"K": "2"}) and forms("u<!why>v  w") == ["uvw"]
    # A flag set before a form is open stays for the next.
    first = markup.tokenize("[:u]<->vel")[0][0]
    assert first["form"] == "vel" and first["has_alternative"] and first["sep_before"] == "-"
    for raw in ("sol<!never ends", "so[l:m", "so{lm", "so@9;l", "sol}", "{so{l}}", "{so<!x>}", "<?>"):
        with pytest.raises(markup.MarkupError):
            markup.tokenize(raw)


def test_registry_gate_and_store(spark, tmp_path):
    source, registry, store = tmp_path / "a.txt", str(tmp_path / "registry.json"), str(tmp_path / "store")
    source.write_text(FILE)
    with pytest.raises(provenance.RegistryError):
        provenance.run_ingest(spark, registry, str(source), store)
    entry = provenance.register(spark, registry, str(source), "http://x", "public domain", at="2020-01-01")
    provenance.register(spark, registry, f"{tmp_path}/./a.txt", "http://y", "public domain", "again")
    assert [e["url"] for e in provenance.load_registry(registry)] == ["http://y"] and provenance.load_registry(str(tmp_path / "none")) == []
    provenance.run_ingest(spark, registry, str(source), store)
    back = provenance.load_relations(spark, store, views=True)
    assert back["loci"].count() == 6 and spark.table("pages").count() == 2
    assert provenance.read_meta(spark.read.parquet(f"{store}/ingest_meta"))["sha256"] == entry["sha256"]
    source.write_text(FILE + "\n")
    with pytest.raises(provenance.RegistryError):
        provenance.require_registered(spark, registry, str(source))
    with pytest.raises(provenance.RegistryError):
        provenance.register(spark, registry, str(tmp_path / "missing"), "", "")
    provenance.write_markdown(str(tmp_path / "r.md"), "t", {"pages": back["pages"].select("name", "seq").orderBy("seq")})
    assert [tuple(r) for r in provenance.read_markdown(spark, str(tmp_path / "r.md"), "pages").collect()] == [("p7", "0"), ("q1v", "1")]
