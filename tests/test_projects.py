"""Six small projects, each with all relations that an analysis of it must give."""

import pytest

from codestrata.operators.analysis import Analysis

GO = {
    "files": {"store.go": "package store\n\ntype Stock struct{}\n\nfunc (s Stock) Count() {\n\ttotal()\n}\n", "sum.go": "package store\n\nfunc total() {}\n"},
    "symbols": {("Stock", None, "class", "store.go", 3, 3), ("Count", "Stock.Count", "method", "store.go", 5, 7), ("total", "total", "function", "sum.go", 3, 3)},
    "dependencies": {("Stock.Count", "total", "calls", 6)},
}
SQL = {
    "files": {"fix.sql": "UPDATE dbo.Prices\nSET Amount = 'A'\n"},
    "symbols": {("query_1", None, "query", "fix.sql", 1, 1)},
    "fields": {("dbo.Prices", "Amount", "write", "fix.sql", 1, "query_1")},
    "risks": {("Write statement without WHERE clause", "missing_condition", "critical", "fix.sql", 1)},
}
EVENT = {
    "files": {
        "Main.pas": "unit Main;\n\ninterface\n\ntype\n  TMain = class\n  public\n    procedure SaveClick(Sender: TObject);\n  end;\n\nimplementation\n\nprocedure TMain.SaveClick(Sender: TObject);\nbegin\nend;\n\nend.\n",
        "Main.dfm": "object Main: TMain\n  object Save: TButton\n    OnClick = SaveClick\n  end\n  object Lost: TButton\n    OnClick = LostClick\n  end\nend\n",
    },
    "symbols": {
        ("Main", "Main", "class", "Main.pas", 1, 18), ("TMain", "TMain", "class", "Main.pas", 6, 9), ("SaveClick", "SaveClick", "procedure", "Main.pas", 8, 9), ("SaveClick", "TMain.SaveClick", "method", "Main.pas", 13, 15),
        ("Main", "Main", "class", "Main.dfm", 1, 9), ("OnClick", "Main.Save.OnClick", "method", "Main.dfm", 3, 3), ("OnClick", "Main.Lost.OnClick", "method", "Main.dfm", 6, 6),
    },
    "dependencies": {("Main.Save.OnClick", "SaveClick", "references", 3), ("Main.Lost.OnClick", "LostClick", "references", 6)},
    "events": {("Main", "Save", "TButton", "OnClick", "SaveClick", "Main.dfm", 3, "TMain.SaveClick", "Main.pas", "resolved"), ("Main", "Lost", "TButton", "OnClick", "LostClick", "Main.dfm", 6, None, None, "unresolved")},
}
BINDING = {
    "files": {
        "Card.dfm": "object Card: TCard\n  object cds: TClientDataSet\n  end\n  object ds: TDataSource\n    DataSet = cds\n  end\n  object edName: TDBEdit\n    DataSource = ds\n    DataField = 'NAME'\n  end\n  object cbOn: TDBCheckBox\n    DataSource = ds\n    DataField = 'ON'\n  end\n"
        "  object grid: TDBGrid\n    DataSource = ds\n    Columns = <\n      item\n        FieldName = 'ID'\n      end\n      item\n        FieldName = 'NAME'\n      end\n    >\n  end\nend\n",
    },
    "symbols": {("Card", "Card", "class", "Card.dfm", 1, 27)},
    "risks": {("Delphi database component detected", "other", "low", "Card.dfm", n) for n in (2, 8, 12, 16)},
    "bindings": {("Card", c, k, "ds", "cds", f, "read-write", "high", "Card.dfm") for c, k, f in (("edName", "TDBEdit", "NAME"), ("cbOn", "TDBCheckBox", "ON"), ("grid", "TDBGrid", "ID"), ("grid", "TDBGrid", "NAME"))},
}


def access(call, field, title):
    return {
        "files": {"Store.pas": f"unit Store;\n\ninterface\n\nimplementation\n\nprocedure Keep;\nbegin\n  Query.{call}('{field}').AsString := '';\nend;\n\nend.\n"},
        "symbols": {("Store", "Store", "class", "Store.pas", 1, 13), ("Keep", "Keep", "procedure", "Store.pas", 7, 10)},
        "fields": {("delphi", field, "write", "Store.pas", 9, "Keep")},
        "risks": {(title, "other", "low", "Store.pas", 9)},
    }


PROJECTS = {"go across files": GO, "sql without condition": SQL, "form events": EVENT, "data bindings": BINDING, "fields by name": access("FieldByName", "City", "Delphi field access detected"), "parameters by name": access("ParamByName", "Number", "Delphi query parameter usage detected")}


@pytest.mark.parametrize("name", PROJECTS)
def test_project(spark, name):
    p = PROJECTS[name]
    a = Analysis(spark.createDataFrame([(1, n, path, text) for n, (path, text) in enumerate(p["files"].items())], "projectId long, id long, filePath string, content string"))
    of = lambda df, *c: {tuple(r) for r in df.select(*c).collect()}
    got = {
        "symbols": of(a.symbols, "name", "qualifiedName", "type", "file", "startLine", "endLine"),
        "fields": of(a.references, "tableName", "field", "access", "file", "line", "ownerName"),
        "dependencies": of(a.edges, "fromName", "toName", "type", "line"),
        "risks": of(a.risks, "title", "category", "severity", "file", "line"),
        "rules": of(a.rules, "name"),
        "events": of(a.handlers, "formName", "component", "componentClass", "event", "handler", "file", "line", "method", "methodFile", "status"),
        "bindings": of(a.bindings, "formName", "component", "componentClass", "dataSource", "dataSet", "dataField", "accessHint", "confidence", "file"),
    }
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in p.items() if k != "files"}
