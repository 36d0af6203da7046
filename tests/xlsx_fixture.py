"""Write a minimal .xlsx (inline strings, numbers, formulas, a date style)."""

import zipfile


def _col(n):
    s = ""
    while n:
        n, r = divmod(n - 1, 26)
        s = chr(65 + r) + s
    return s


def _cell(ref, v):
    if v is None:
        return ""
    if isinstance(v, tuple) and v[0] == "formula":
        return f'<c r="{ref}"><f>{v[1]}</f></c>'
    if isinstance(v, tuple) and v[0] == "date":
        return f'<c r="{ref}" s="1"><v>{v[1]}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"><v>{v}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{v}</t></is></c>'


def write_xlsx(path, sheets):
    """sheets: list of (name, rows) — rows are lists of cell values."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>')
        sheet_xml = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, (n, _) in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook {ns} {rns}><sheets>{sheet_xml}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i + 1}" Type="worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        z.writestr("xl/styles.xml", f'<?xml version="1.0"?><styleSheet {ns}><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for i, (_, rows) in enumerate(sheets):
            body = "".join(f'<row r="{r + 1}">' + "".join(_cell(f"{_col(c + 1)}{r + 1}", v) for c, v in enumerate(row)) + "</row>"
                           for r, row in enumerate(rows))
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<?xml version="1.0"?><worksheet {ns}><sheetData>{body}</sheetData></worksheet>')
