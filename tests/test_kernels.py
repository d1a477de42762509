import numpy as np
import pytest

from castellan.kernels import boards, distance, images, lines, tokens, tree
from castellan.kernels.resolve import resolve
from castellan.kernels.rules import START, Position
from castellan.kernels.tokens import PageText


def page(text, number=1, consumed=None):
    return PageText(number, text, [(float(i), 700.0, 1.0, 10.0) for i in range(len(text))], consumed or [""] * len(text))


def read(text, letters="KQRBN", **kw):
    return tree.build(tokens.tokenize(page(text), letters), **kw)


def kinds(text, letters="KQRBN"):
    return [(t.kind, t.text) for t in tokens.tokenize(page(text), letters)]


def test_main_line():
    r = read("1.e4 e5 2.Nf3 Nc6")
    assert [(m.san, m.status, m.ply) for m in r.moves] == [("e4", "ok", 1), ("e5", "ok", 2), ("Nf3", "ok", 3), ("Nc6", "ok", 4)]
    assert [m.parent_id for m in r.moves] == [None, "g1-m1", "g1-m2", "g1-m3"]


def test_dotless_numbers_and_letters_of_a_language():
    assert [t for t in kinds("1 e4 c5 2 Nf3 Nc6 3 d4 cxd4 4 Nxd4") if t[0] == "move_number"] == [("move_number", str(k)) for k in (1, 2, 3, 4)]
    assert [m.san for m in read("1. e4 e5 2. Cf3 Cc6 3. Fb5", "RDTFC").moves] == ["e4", "e5", "Nf3", "Nc6", "Bb5"]
    assert ("move", "Rh1") in kinds("4. Th1", "RDTFC") and ("move", "Kh1") in kinds("4. Rh1", "RDTFC")


def test_tokens_keep_raw_text_and_offsets():
    text = "Prose comes first 1 8 ... ♘f3!? then (a line) 1/2-1/2"
    for t in tokens.tokenize(page(text)):
        assert t.raw == text[t.start : t.end]
    assert ("move_number", "18...") in kinds(text) and ("move", "Nf3") in kinds(text) and ("annotation", "!?") in kinds(text) and ("result", "1/2-1/2") in kinds(text)


def test_wreck_before_a_move():
    found = {t.text: t.lost_symbol for t in tokens.tokenize(page("12 fi>h1 c5 jouer...e5 i.g7")) if t.kind == "move"}
    assert found == {"h1": "fi>", "c5": "", "e5": "", "g7": "i."}
    assert ("move", "f6") not in kinds("wordf6")


def test_black_number_licenses_one_move():
    r = read("1. e4 e5 2... Nc6 Nf6")
    assert [m.san for m in r.moves] == ["e4", "e5", "Nc6"] or r.skipped
    assert [(t.text, why) for t, why in r.skipped] == [("Nf6", "no move number in context")]


def test_bracketed_variation():
    r = read("1. e4 e5 (1... c5) 2. Nf3")
    assert [(m.san, m.parent_id, m.variation_index) for m in r.moves] == [("e4", None, 0), ("e5", "g1-m1", 0), ("c5", "g1-m1", 1), ("Nf3", "g1-m2", 0)]


def test_prose_variation_by_number_and_resumption():
    r = read("1. e4 e5 2. Nf3 Nc6 3. Bb5 a6. Another idea is 2... d6 3. d4, but 4. Ba4 Nf6")
    by = {m.id: m for m in r.moves}
    assert [m.san for m in r.moves] == ["e4", "e5", "Nf3", "Nc6", "Bb5", "a6", "d6", "d4", "Ba4", "Nf6"]
    assert by["g1-m7"].parent_id == "g1-m3" and by["g1-m7"].variation_index == 1 and by["g1-m9"].parent_id == "g1-m6"


def test_illegal_move_and_taint():
    r = read("1. e4 e5 2. Ra5 3. Nc3")
    assert [m.status for m in r.moves] == ["ok", "ok", "broken", "ok"]
    assert tree.clean_moves(r) == 2 and r.moves[2].san == "Ra5" and r.moves[2].fen is None


def test_titles_comments_results_and_unknown_start():
    r = read("Ivanov and others 1. e4 good move e5 1-0 12. Nb1 Nd7")
    assert r.games[0].title == "Ivanov and others" and r.moves[0].comment == "good move"
    assert [g.position_known for g in r.games] == [True, False] and r.moves[-1].status == "broken"
    assert r.skipped and r.skipped[0][0].text == "e5"


def test_second_first_move_opens_a_game():
    assert [g.id for g in read("1. e4 e5 1. d4 d5").games] == ["g1", "g2"]


def board(text):
    p = Position.parse(START)
    for san in text.split():
        p = p.play(p.read(san))
    return p


def test_resolver():
    assert resolve(board(""), "e4!?").status == "ok"
    r = resolve(board("e4 e5 Nf3 Nc6"), "8b5")
    assert (r.san, r.status, r.confidence) == ("Bb5", "uncertain", 0.75)
    two = Position.parse("4k3/8/8/8/8/5N2/8/1N2K3 w - - 0 1")
    assert resolve(two, "Nd2").status == "broken"
    r = resolve(two, "Nd2", consumed="4)b")
    assert (r.san, r.confidence, r.settled_by) == ("Nbd2", 0.6, "consumed")
    assert resolve(two, "Nd2", consumed="bf").status == "broken"
    r = resolve(board("d4 Nf6 c4 g6 Nc3"), "g7", wreck="i.")
    assert (r.san, r.status, r.confidence) == ("Bg7", "uncertain", 0.5)
    r = resolve(board("d4 Nf6 c4"), "g8", wreck="i.")
    assert r.status == "broken" and r.candidates == ("Rg8", "Ng8")
    r = resolve(board("e4 e5"), "Nbf3")
    assert (r.san, r.status, r.confidence) == ("Nf3", "uncertain", 0.5)
    assert resolve(board("e4 e5"), "Qh9").status == "broken"


def test_distances():
    d = distance.confusable_distance
    assert (d("8b5", "Bb5"), d("Nf3", "Nf4"), d("O-O", "0-0"), d("Nd2", "Nbd2"), d("", "ab")) == (0.5, 1, 1, 1, 2)
    assert distance.common_subsequence("NBRQ", "NRQK") == 3


FONT = {"T": "r", "S": "n", "L": "b", "D": "q", "M": "k", "J": "p", "R": "R", "N": "N", "B": "B", "Q": "Q", "K": "K", "I": "P", ".": "."}
BACK = {v: k for k, v in FONT.items()}


def drawn(placement):
    return ["".join(BACK[c] for c in row) for row in boards.ranks(placement)]


def test_diagram_found_learnt_and_decoded():
    start = START.split()[0]
    rows = drawn(start)
    assert [r for _, _, r in boards.find("Words before.\n" + "\n".join(rows) + "\nand after")] == [rows]
    table = boards.learn([(rows, [start])])
    other = "r1bq1rk1/pp2ppbp/2np1np1/8/2P1P3/2N1BP2/PP2N1PP/R2QKB1R"
    assert boards.decode(drawn(other), table) == other
    assert boards.learn([(rows, [start])], least=2) == {}
    assert boards.decode(["........"] * 7 + [".......?"], table) is None


def test_framed_and_doubled_diagram():
    rows = drawn("r1bq1rk1/pp2ppbp/2np1np1/8/2P1P3/2N1BP2/PP2N1PP/R2QKB1R")
    framed = ["+" * 10] + [f"|{r}|" for r in rows] + ["-" * 10]
    assert [r for _, _, r in boards.find("\n".join(framed))] == [rows]
    assert [r for _, _, r in boards.find("\n".join(x for r in rows for x in (r, r)))] == [rows]


def test_diagram_corrects_the_line():
    rows = "/".join(drawn("rnbqkbnr/pppp1ppp/8/4p3/4P3/8/PPPP1PPP/RNBQKBNR"))
    make = lambda kind, text: tokens.Token(kind, text, text, 1, 0, 1, (0, 0, 1, 1))
    seq = [make("move_number", "1."), make("move", "d4"), make("move", "d5"), make("diagram", rows), make("move_number", "2."), make("move", "Nf3")]
    r = tree.build(seq, table=FONT)
    assert r.checks[0]["verdict"] == "corrects" and set(r.contradicted) == {"g1-m1", "g1-m2"}
    assert r.moves[-1].fen.startswith("rnbqkbnr/pppp1ppp/8/4p3/4P3/5N2")
    assert tree.build(seq).checks[0]["verdict"] == "unread"


def test_settle_keeps_all_best_tables():
    rows = drawn("rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR")
    twins = [("K", "M"), ("Q", "D"), ("R", "T"), ("B", "L"), ("N", "S"), ("I", "J")]
    found = boards.settle([rows], twins, ".")
    assert FONT in found and boards.full_fen("rnbqkbnr/8/8/8/8/8/8/R3K2N", 3, True) == "rnbqkbnr/8/8/8/8/8/8/R3K2N b Qkq - 0 3"


def test_case_partner():
    assert boards.partner("p") == "P" and boards.partner("") == "" and boards.partner(".") is None


def two_columns(n=10, gutter=232.0):
    text, boxes = "", []
    for k in range(n):
        for x in (20.0, gutter):
            part = f"{k + 1}. e4 e5 and more words here now"
            boxes += [(x + 5 * i, 600.0 - 20 * k, 5.0, 14.0) for i in range(len(part))] + [(0.0, 0.0, 0.0, 0.0)]
            text += part + "\n"
    return PageText(1, text[:-1], boxes[:-1], [""] * (len(text) - 1))


def test_columns_and_lines():
    found = lines.segment(two_columns(), 472)
    assert len(found) == 20 and [x.column for x in found] == [0] * 10 + [1] * 10
    assert all(x.has_notation for x in found) and lines.covered([(0, 5), (3, 8), (10, 11)]) == 9
    assert [x.text[0] for x in lines.with_notation([found[0], lines.Line(1, found[1].bbox, "plain", (), 0, 1.0), lines.Line(1, found[1].bbox, "plain", (), 0, 1.0)])] == ["1", "p"]


def chars(text):
    return [lines.Char(c, (20.0 + 5 * i, 100.0, 5.0, 14.0), "GlyphLessFont", 10.0) for i, c in enumerate(text)]


def test_repair():
    out = lines.repair(chars("tZJg3 x"), [("N", (20.0, 100.0, 10.0, 14.0))])
    assert "".join(c.char for c in out) == "♘g3 x" and out[0].consumed == "tZJ"
    inserted = lines.repair(chars("4...e8"), [("R", (40.0, 100.0, 0.5, 14.0))])
    assert "".join(c.char for c in inserted) == "4...♖e8"


def test_clusters():
    rng = np.random.default_rng(0)
    base = rng.random((13, 20))
    squares = [b + rng.normal(0, 0.001, 20) for b in base for _ in range(6)] + [base[0] + 0.02]
    assert len(set(images.cluster(squares))) == 13


SHAPES = ("##.. ##.. #### ####", "#### .##. .##. ####", "#### #### ##.. ##..", "##.. ###. .### ..##", "..## #### ##.. ##..", ".##. #### #### .##.")


def synthetic_board(placement, cell=40):
    """A framed board of silhouettes; black ones are filled, white ones outlined."""
    side = 8 * cell
    image = np.ones((side + 12, side + 12), np.float32)
    image[:6] = image[-6:] = 0
    image[:, :6] = image[:, -6:] = 0
    for r, row in enumerate(boards.ranks(placement)):
        for c, piece in enumerate(row):
            y, x = 6 + r * cell, 6 + c * cell
            if (r + c) % 2:
                image[y : y + cell, x : x + cell] = 0.8
            if piece == ".":
                continue
            shape = np.zeros((cell, cell), bool)
            mask = np.array([[c == "#" for c in row] for row in SHAPES["kqrbnp".index(piece.lower())].split()])
            shape[8:32, 8:32] = np.kron(mask, np.ones((6, 6))) > 0
            spot = image[y : y + cell, x : x + cell]
            if piece.islower():
                spot[shape] = 0.0
            else:
                spot[shape] = 0.0
                inner = shape.copy()
                inner[1:] &= shape[:-1]
                inner[:-1] &= shape[1:]
                inner[:, 1:] &= shape[:, :-1]
                inner[:, :-1] &= shape[:, 1:]
                spot[inner] = 0.9
    return image


def test_drawn_boards_learn_and_decode():
    places = ["rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR", "r1bq1rk1/pp2ppbp/2np1np1/8/2P1P3/2N1BP2/PP2N1PP/R2QKB1R", "8/5pk1/6p1/8/8/6P1/5PK1/8"]
    squares = []
    for p in places:
        image = synthetic_board(p)
        region = images.board_region(image)
        assert region is not None
        squares += images.signatures(image, region)
    labels = images.cluster(squares)
    text = "".join(chr(images.FIRST_CHAR + k) for k in labels)
    rows = [[text[64 * b + 8 * r : 64 * b + 8 * r + 8] for r in range(8)] for b in range(3)]
    table = boards.learn([(rows[0], [places[0]]), (rows[1], [places[1]])])
    assert boards.decode(rows[2], table) == places[2]
    empty, pairs = images.twins(squares, labels)
    assert table[empty] == "." and len(pairs) == 6


def test_components_and_features():
    crop = np.full((50, 200), 255, np.uint8)
    crop[10:40, 20:50] = 0
    crop[10:40, 80:95] = 0
    crop[2:4, 120:122] = 0
    assert images.components(crop) == [(20, 10, 30, 30), (80, 10, 15, 30)]
    assert images.glyph_candidates([(20, 10, 30, 30), (80, 10, 15, 30)], 15.0) == [(20, 10, 30, 30)]
    assert images.hog(crop).shape == (1767,) and images.median_width([(0, 0, 3, 1), (0, 0, 6, 1)]) == 4.5
    assert images.longest_run(np.array([0, 1, 1, 0, 1], bool)) == (1, 2) and images.longest_run(np.zeros(3, bool)) is None
    ink = np.zeros((100, 100), bool)
    ink[10, 10:91] = ink[90, 10:91] = True
    ink[10:91, 10] = ink[10:91, 90] = True
    across, down = images.rules(ink, 50), images.rules(ink.T, 50)
    assert images.squares_between(across, down, 40, 90) == [(11, 90, 11, 90)]


@pytest.mark.parametrize("text", ["", "\n\n", "()", "1.", "e4" * 200])
def test_odd_texts_do_not_fail(text):
    read(text)
