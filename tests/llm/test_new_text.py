from mailweave.llm import newtext
from test_operators import boxes, ingest, mail


def test_readable_new_text(spark):
    old = "Это длинный абзац, который был написан раньше другим человеком."
    rows = [
        {"message_id": "<1@x>", "body": old, "date_text": "2001-01-01 00:00:00Z"},
        {"message_id": "<2@x>", "body": f"Größe 5, über alles!\n\nДа, согласен.\n\n:-)\n\n{old}\n\nCheers,\nBob", "date_text": "2001-01-02 00:00:00Z"},
        {"message_id": "<3@x>", "body": "On Mon, 1 Jan 2001, Bob wrote:\n\n> Hi,\n\nInline\nanswer.\n\n> more"},
        {"body": "> all old"}, {"body": None}, {"body": ""},
    ]
    threads = ingest(spark, [(i, "t") for i in range(1, 7)])
    got = {r.row_idx: r.new_text for r in newtext.new_texts(mail(spark, rows), threads, boxes(spark)).collect()}
    assert got == {1: old, 2: "Größe 5, über alles!\n\nДа, согласен.\n\n:-)", 3: "Inline\nanswer.", 4: "", 5: None, 6: ""}
