import pytest
from loomgraph.functions import stems
from loomgraph.operators import lexical

# Published examples of the Snowball stemmers.
EXAMPLES = {
    "english": "consigned:consign consignment:consign consistency:consist consistently:consist consolation:consol consolatory:consolatori consolidating:consolid consolingly:consol conspicuously:conspicu conspiracy:conspiraci conspirators:conspir constables:constabl constancy:constanc knackeries:knackeri knavish:knavish kneaded:knead knightly:knight knives:knive knitting:knit knockers:knocker generate:generat generally:general generic:generic generously:generous hoping:hope hopping:hop happy:happi cries:cri ties:tie gas:gas gaps:gap kiwis:kiwi luxuriated:luxuri by:by say:say skies:sky news:news inning:inning national:nation relational:relat digitizer:digit operator:oper feudalism:feudal decisiveness:decis hopefulness:hope boyish:boyish adoption:adopt rate:rate controlling:control roll:roll",
    "spanish": "cheque:chequ chibcha:chibch chica:chic chicago:chicag chicharrones:chicharron chicharrón:chicharron chichimecas:chichimec torá:tor tórax:torax torcer:torc toreado:tor toreándolo:tor torear:tor toreara:tor torearlo:tor toreó:tore torero:torer torio:tori tormenta:torment tornado:torn tornen:torn torneo:torne tornillo:tornill torniquete:torniquet toronto:toront torpedearon:torped torpeza:torpez torrado:torr torre:torr torrencial:torrencial torrente:torrent torreón:torreon torrescano:torrescan",
    "italian": "abbandonata:abbandon abbandonava:abbandon abbandonerà:abbandon abbandoneranno:abbandon abbandonò:abbandon abbaruffato:abbaruff abbassamento:abbass abbassando:abbass abbassandola:abbass abbassar:abbass abbassarono:abbass abbassarsi:abbass abbassassero:abbass abbassò:abbass abbastanza:abbast abbatté:abbatt abbattendo:abbatt abbattersi:abbatt abbattesse:abbattess abbattevamo:abbatt abbattimento:abbatt abbattuta:abbatt abbellita:abbell pronto:pront pronuncia:pronunc pronunciamento:pronunc pronunciare:pronunc propaganda:propagand propagasse:propag propagazione:propag propaghino:propaghin propende:prop propensione:propension propio:prop propizio:propiz propone:propon proponendosi:propon proponenti:proponent proponga:propong proponghiamo:propong proponiamo:propon proponimento:propon proporre:proporr",
}


@pytest.mark.parametrize("name", sorted(EXAMPLES))
def test_published_examples(name):
    pairs = [p.split(":") for p in EXAMPLES[name].split()]
    assert [(w, stems.STEMMERS[name](w)) for w, _ in pairs] == [tuple(p) for p in pairs]


@pytest.mark.parametrize("name", sorted(stems.STEMMERS))
def test_any_word_has_a_stem(name):
    for w in ("", "a", "s", "y", "yy", "ing", "ed", "ción", "gu", "que", "12", "中文", "iiii", "ssss", "é", "aeiou" * 50):
        assert isinstance(stems.STEMMERS[name](w), str)


def test_only_allowed_names(spark):
    with pytest.raises(ValueError, match="no analyser 'french'"):
        lexical.stemmed(spark.createDataFrame([("a",)], "term string"), "french")


DOCS = [(1, "The connection was connected"), (2, "connecting flights"), (3, "la casa della nazione"), (4, None), (5, "the of and"), (6, "Flight, flights; FLIGHT")]


def test_documents_meet_by_stem_and_stop_words_are_nowhere(spark):
    docs, asked = spark.createDataFrame(DOCS, "id long, text string"), spark.createDataFrame([(1, "the connections"), (2, "flight of the"), (3, "the and")], "qid long, text string")
    hits = lambda **o: sorted((r.qid, r.id) for r in lexical.bm25(docs, asked, analyser="english", **o).collect())
    assert hits() == [(1, 1), (1, 2), (2, 2), (2, 6)] == hits(every_term=True)
    index = lexical.Index(docs, lexical.store.shared_path(spark, "index"), "english")
    row = index.collection.first()
    assert row.n == 6 and row.avgdl == (1 + 2 + 4 + 1 + 1 + 1) / 6 and row.avgtokens == (2 + 2 + 4 + 1 + 1 + 3) / 6
    assert sorted((r.id, r.term, r.tf, r.dl, r.tokens) for r in index.postings.filter("id in (1, 6)").collect()) == [(1, "connect", 2, 1, 2), (6, "flight", 3, 1, 3)]


def test_other_languages_and_stop_words_of_ones_own(spark):
    docs, asked = spark.createDataFrame(DOCS, "id long, text string"), spark.createDataFrame([(1, "le nazioni"), (2, "connection")], "qid long, text string")
    assert [(r.qid, r.id) for r in lexical.bm25(docs, asked, analyser="italian").collect()] == [(1, 3), (2, 1)]
    index = lexical.Index(docs, lexical.store.shared_path(spark, "index"), "simple", frozenset({"connection"}))
    assert [r.qid for r in lexical.bm25(index, asked).collect()] == []
    assert lexical.bm25(docs.limit(0), asked, analyser="english").count() == 0
