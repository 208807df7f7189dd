"""A small release package with the shapes of a real one; all content made up here."""

import os


def rows(*lines):
    return "\r\n".join(lines) + "\r\n"


FILES = {
    "COPYRGHT": "Made-up notice for tests.\n",
    "FI/FI/fi_B_20260101.csv": rows(
        "B01 ,1,m1,s1,3", "B01D,2,,,4", '"B01D 10/00",3,m3,,5', "B01D10/02,4,,,6", "B01D10/04,5,,,6", "B01D10/04,6,x,y,7", "bad,1", "B01D12/00,7,,,5"
    ),
    "FI/FI_TEXT/fiText_B_20260101.csv": rows("B01D10/00,1,1,,,,濾過器", '"B01D10/02",1,1,,,,"二行\nの説明, 記号入り"', "B99Z1/00,1,1,,,,無い符号"),
    "FI/FI_TEXT_E/fiTextE_B_20260101.csv": rows("B01D10/00,1,1,,,,Filter vessels", "B01D10/02,1,1,,,,(Not Translated)"),
    "FI/FI_HB/fiHB_B_20260101.csv": rows("B01D10/00,1,k,,手引きの本文", "B01D10/02,2,k,,"),
    "FI/FI_THEME/fiTheme_B_20260101.csv": rows("B01D10/00,,9Z,001,", "B01D10/02,,9Z,999,"),
    "FI/FI_KAISEI_LINK/fiLink_B_20260101.csv": rows("B01D,改正,あり"),
    "FI/FI_KAISEI_DOC/B01D.xml": '<?xml version="1.0" encoding="UTF-8"?><data trg="B01D"><infor><FI>B01D8/00</FI><trans>B01D10/00</trans><title>移行</title></infor><infor><FI>B01D10/02</FI><trans/></infor></data>',
    "FI/FI_KAISEI_DOC/fi.xsl": '<xsl:stylesheet version="1.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform"/>',
    "FTERM/THEME/theme_20260101.csv": rows("9Z001,1,,,,scope,主題,備考", "note,1,,,,,,"),
    "FTERM/THEME_E/themeE_20260101.csv": rows("9Z001,2,,,,scope,Topic,remark", "9Z777,1,,,,,None,"),
    "FTERM/FTERM/fterm_9Z_20260101.csv": rows("9Z001AA01,1,0,根,sc", "9Z001AA02,2,1,枝,つづき,sc", "9Z001AA03,3,1,枝二,sc", "9Z001BB01,4,1,別,sc"),
    "FTERM/FTERM_E/ftermE_9Z_20260101.csv": rows("9Z001AA01,1,0,root,sc", "9Z001AA02,9,1,branch,sc", "9Z001AA03,3,2,branch two,sc"),
    "IPC/IPC8U_TEXT/ipc8U_B_20260101.csv": rows(
        "B01D  10/00,(2006.01),1,1,5,,,20060101,20151231,,旧い題", "B01D  10/00,(2016.01),1,1,5,,,20160101,99991231,,新しい題", "B01D  10/02,(2006.01),1,1,6,,,20060101,99991231,,子の題", "B01D  10/04,(2006.01),0,1,6,,,20060101,99991231,,bad",
    ),
    "IPC/IPC8B_TEXT/ipc8B_B_20260101.csv": rows("B01D10/00,x,1,1,5,,,,基礎の題"),
    "IPC_KAISEI/Kaisei.html": "<html><head><title>改正表</title></head><table><tr><th>旧<th>版<th>新<th>版</tr><tr><td colspan=4>B部</td></tr><tr><td>B01D 10/00</td><td>(2006.01)</td><td>B01D 10/00</td><td>(2016.01)</td></tr><tr><td>B01D 10/00</td><td>(1999.01)</td><td>B01D 10/02</td><td>(2006.01)</td></tr><tr><td></td></tr></table></html>",
    "REFERENCE/IPC_TEIGI/B01D_10-00.pdf": "%PDF-1.4 stub",
    "CONCORDANCE/con_20260101.csv": rows("1,B01D10/00,8,B01D10/00", "1,B01D77/00,4,B01D9/00"),
    "JUDGE/judge_20260101.csv": rows("A,一致"),
}


def write(root):
    for name, text in FILES.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        encoding = "cp932" if "fiText_B" in name else "utf-8-sig" if "theme_" in name else "utf-8"
        with open(path, "w", encoding=encoding, newline="") as f:
            f.write(text)
    return str(root)
