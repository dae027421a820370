"""Sources in every language with the tokens and symbols that they should yield; the queries make files of them for each nation.

The expectations were read through against the rules of each language and pin the output: a change of theirs must be meant.

A source is written with its tokens marked: a letter for the class (keyword, identifier, literal, comment, operator,
punctuation), then the text in brackets; what stands between is white space.  ``{k}`` becomes the nation's key.  A symbol
is its name, kind, language kind and owner, and the numbers of its first and last token.
"""

from __future__ import annotations

import re
from typing import NamedTuple

CLASSES = {"k": "keyword", "i": "identifier", "l": "literal", "c": "comment", "o": "operator", "p": "punctuation"}
_MARK = re.compile("([kilcop])‹(.*?)›", re.S)


class Sample(NamedTuple):
    extension: str
    marked: str
    declared: str

    def tokens(self) -> list[tuple[str, str, str]]:
        """(white space before, text, class) of each token; then the white space at the end."""
        out, at = [], 0
        for m in _MARK.finditer(self.marked):
            out.append((self.marked[at : m.start()], m[2], CLASSES[m[1]]))
            at = m.end()
        return [*out, (self.marked[at:], "", "")]

    def source(self) -> str:
        return "".join(gap + text for gap, text, _ in self.tokens())

    def symbols(self) -> list[tuple]:
        """(name, kind, language kind, owner or None, first token, last token)."""
        rows = [line.split("|") for line in self.declared.strip().split("\n")]
        return [(n, k, lk, o or None, int(a), int(b)) for n, k, lk, o, a, b in rows]


SAMPLES = {
    "asm": Sample("asm", """k‹section› p‹.›i‹text{k}›
i‹main{k}›p‹:› c‹; c›
 i‹mov› i‹eax›p‹,› l‹1›
i‹X{k}› i‹equ› l‹5›
i‹msg› i‹db› l‹'h''i'›
""", """
.text{k}|module|section||0|15
main{k}|function|label||3|12
X{k}|constant|equ||10|12
msg|variable|data||13|15
"""),
    "aspx": Sample("aspx", """p‹<%@› i‹Page› i‹Language›o‹=›p‹'›i‹C›p‹#›p‹'› p‹%>›
c‹<%-- c --%>›
o‹<›i‹asp:Button› i‹id›o‹=›l‹"b{k}"› i‹runat›o‹=›l‹"server"› o‹/›o‹>›
p‹<%=› i‹Foo{k}›p‹(›l‹1›p‹)› p‹%>›
""", """
Page|other|directive||0|8
b{k}|other|control||10|19
Foo{k}|other|expression||20|25
"""),
    "c": Sample("c", """p‹#›i‹define› i‹X{k}› l‹1›
k‹struct› i‹S{k}› p‹{› k‹int› i‹a›p‹;› p‹}›p‹;›
k‹typedef› k‹int› i‹T{k}›p‹;›
k‹int› i‹f{k}›p‹(›k‹int› i‹a›p‹)› p‹{› k‹if› p‹(›i‹a›p‹)› p‹{› k‹return› l‹'c'›p‹;› p‹}› p‹}›
k‹int› i‹g{k}› o‹=› l‹2›p‹,› i‹h›p‹;›
k‹enum› i‹E{k}› p‹{› i‹A›p‹,› i‹B› o‹=› l‹1› p‹}›p‹;› c‹/* d */›
""", """
X{k}|other|macro||0|3
S{k}|type|struct||4|11
T{k}|type|typedef||12|15
f{k}|function|function||16|32
g{k}|variable|variable||33|39
E{k}|type|enum||40|49
A|constant|enumerator||43|43
B|constant|enumerator||45|47
"""),
    "cobol": Sample("cbl", """       k‹IDENTIFICATION› k‹DIVISION›p‹.›
       k‹PROGRAM-ID›p‹.› i‹HELLO-{k}›p‹.›
      c‹* comment›
       k‹DATA› k‹DIVISION›p‹.›
       k‹WORKING-STORAGE› k‹SECTION›p‹.›
       l‹01› i‹REC-{k}› k‹PIC› i‹X›p‹.›
       k‹PROCEDURE› k‹DIVISION›p‹.›
       i‹MAIN-PARA›p‹.›
           k‹DISPLAY› l‹'it''s'›p‹.›
""", """
HELLO-{k}|module|program||0|26
IDENTIFICATION|other|division||0|2
DATA|other|division||8|18
WORKING-STORAGE|other|section||11|18
REC-{k}|variable|level-01||14|18
PROCEDURE|other|division||19|26
MAIN-PARA|function|paragraph||22|26
"""),
    "cpp": Sample("cpp", """k‹namespace› i‹N{k}› p‹{› k‹class› i‹A{k}› p‹{› o‹~›i‹A{k}›p‹(›p‹)› p‹{›p‹}› k‹int› i‹m›p‹(›p‹)› k‹const› p‹{› k‹return› l‹1›p‹;› p‹}› k‹int› i‹f›p‹;› p‹}›p‹;› p‹}›
k‹enum› k‹class› i‹E› p‹:› k‹int› p‹{› i‹X{k}›p‹,› i‹Y› p‹}›p‹;› c‹// d›
""", """
N{k}|module|namespace||0|27
A{k}|type|class||3|25
~A{k}|method|destructor||6|11
m|method|method||12|21
f|variable|field||22|24
E|type|enum||28|37
X{k}|constant|enumerator||34|34
Y|constant|enumerator||36|36
"""),
    "csharp": Sample("cs", """k‹namespace› i‹N{k}› p‹{›
  k‹public› k‹class› i‹C{k}› p‹{› k‹public› k‹int› i‹P{k}› p‹{› i‹get›p‹;› i‹set›p‹;› p‹}› k‹const› k‹string› i‹S› o‹=› l‹@"a""b"›p‹;› k‹public› k‹void› i‹M{k}›p‹(›k‹int› i‹x›p‹)› p‹{› i‹F›p‹(›l‹$"{x}"›p‹)›p‹;› p‹}› p‹}›
  k‹enum› i‹E› p‹{› i‹A›p‹,› i‹B› o‹=› l‹1› o‹<›o‹<› l‹2› p‹}›
p‹}›
""", """
N{k}|module|namespace||0|49
C{k}|type|class||3|36
P{k}|variable|property||7|15
S|constant|const||16|21
M{k}|method|method||22|35
E|type|enum||37|48
A|constant|enum_member||40|40
B|constant|enum_member||42|47
"""),
    "elixir": Sample("ex", """i‹defmodule› i‹A{k}› k‹do›
  c‹# c›
  i‹def› i‹f{k}›p‹(›i‹x›p‹)› k‹do›
    i‹x› o‹+› l‹1›
  k‹end›
  i‹defp› i‹g›p‹(›i‹y›p‹)›p‹,› k‹do›p‹:› l‹'z'›
k‹end›
""", """
A{k}|type|defmodule||0|23
f{k}|method|def||4|13
g|method|defp||14|23
"""),
    "fsharp": Sample("fs", 'k‹module› i‹M{k}›\nc‹(* c (* d *) *)›\nk‹type› i‹T{k}› o‹=›\n  k‹member› i‹x›p‹.›i‹Foo› o‹=› l‹1›\nk‹let› i‹f{k}› i‹x\'› o‹=› i‹x\'› o‹+› l‹"s"›\nk‹let› i‹y› o‹=› l‹"""q"""› c‹// e›\n', """
M{k}|module|module||0|22
T{k}|type|type||3|11
Foo|method|member||6|11
f{k}|function|let||12|18
y|variable|let||19|22
"""),
    "gdscript": Sample("gd", """k‹class_name› i‹P{k}›
k‹const› i‹C› o‹=› l‹1›
k‹func› i‹f{k}›p‹(›p‹)›p‹:›
  k‹pass› c‹# c›
k‹var› i‹x{k}› o‹=› l‹"s"›
""", """
P{k}|type|class_name||0|16
C|constant|const||2|5
f{k}|method|func||6|11
x{k}|variable|var||13|16
"""),
    "go": Sample("go", """k‹package› i‹p{k}›
k‹type› i‹A{k}› k‹struct› p‹{› i‹x› i‹int› p‹}›
k‹func› p‹(›i‹r› o‹*›i‹A{k}›p‹)› i‹M{k}›p‹(›p‹)› i‹string› p‹{› k‹return› l‹`r`› p‹}›
k‹func› i‹main›p‹(›p‹)› p‹{› p‹}›
k‹const› i‹C{k}› o‹=› l‹0x1F›
k‹var› i‹v› o‹=› l‹'c'› c‹// d›
""", """
p{k}|module|package||0|36
A{k}|type|struct||2|8
M{k}|method|method|A{k}|9|22
main|function|func||23|28
C{k}|constant|const||29|32
v|variable|var||33|36
"""),
    "haskell": Sample("hs", """k‹module› i‹Main{k}› k‹where›
c‹-- c›
k‹data› i‹T{k}› o‹=› i‹A› o‹|› i‹B›
k‹class› i‹C› i‹a› k‹where›
  i‹m{k}› p‹:›p‹:› i‹a› o‹-›o‹>› i‹a›
i‹f'› p‹:›p‹:› i‹Int›
i‹f'› o‹=› l‹1› c‹{- d {- e -} -}›
""", """
Main{k}|module|module||0|27
T{k}|type|data||4|9
C|type|class||10|20
m{k}|method|method||14|20
f'|function|function||21|27
"""),
    "html": Sample("html", """c‹<!-- c -->›
o‹<›i‹body› i‹id›o‹=›l‹'b{k}'›o‹>›o‹<›i‹script›o‹>›i‹if› p‹(›i‹a›o‹<›i‹b›p‹)› i‹x›p‹(›p‹)›o‹<›o‹/›i‹script›o‹>›o‹<›i‹p› i‹class›o‹=›i‹q›o‹>›i‹it›p‹'›i‹s› l‹{k}›o‹<›o‹/›i‹p›o‹>›o‹<›i‹form›o‹>›o‹<›i‹input› i‹id›o‹=›l‹"i{k}"›o‹>›o‹<›o‹/›i‹form›o‹>›o‹<›o‹/›i‹body›o‹>›
""", """
b{k}|other|element||1|53
script|other|script||7|22
form|other|form||37|49
i{k}|other|element||40|45
"""),
    "java": Sample("java", 'k‹package› i‹a›p‹.›i‹b›p‹;›\nk‹class› i‹C{k}›o‹<›i‹T›o‹>› p‹{› k‹private› k‹int› i‹x{k}› o‹=› l‹1›p‹,› i‹y›p‹;› k‹static› k‹final› k‹int› i‹K› o‹=› l‹2›p‹;› k‹void› i‹m{k}›p‹(›k‹int› i‹a›p‹)› p‹{› k‹if› p‹(›i‹a› o‹>› l‹1›p‹)› p‹{› p‹}› p‹}› p‹}›\nk‹enum› i‹E› p‹{› i‹A{k}›p‹,› i‹B›p‹(›l‹1›p‹)› p‹{› p‹}›p‹,› i‹C›p‹;› i‹String› i‹s›p‹(›p‹)› p‹{› k‹return› l‹"""\n t"""›p‹;› p‹}› p‹}›\n', """
a|module|package||0|66
C{k}|type|class||5|42
x{k}|variable|field||11|18
K|constant|constant||19|25
m{k}|method|method||26|41
E|type|enum||43|66
A{k}|constant|enum_constant||46|46
B|constant|enum_constant||48|53
C|constant|enum_constant||55|55
s|method|method||57|65
"""),
    "javascript": Sample("js", """k‹export› k‹function› i‹f{k}›p‹(›i‹a›p‹)› p‹{› k‹return› l‹/x[/]y/g›p‹.›i‹test›p‹(›i‹a›p‹)› o‹?› i‹a› o‹/› l‹2› p‹:› l‹`t${a}`›p‹;› p‹}›
k‹class› i‹A{k}› p‹{› i‹constructor›p‹(›i‹x›p‹)› p‹{› p‹}› i‹get› i‹v›p‹(›p‹)› p‹{› k‹return› l‹1› p‹}› i‹m{k}›p‹(›i‹a›p‹)› p‹{› k‹if› p‹(›i‹a›p‹)› p‹{› i‹b›p‹(›p‹)› p‹}› p‹}› p‹}›
k‹const› i‹g{k}› o‹=› k‹async› p‹(›i‹x›p‹)› o‹=›o‹>› p‹{› i‹y›p‹(›p‹)› p‹}›p‹;›
""", """
f{k}|function|function||0|21
A{k}|type|class||22|54
constructor|method|constructor||25|30
v|method|get||31|38
m{k}|method|method||39|53
g{k}|function|arrow_fn||55|69
"""),
    "python": Sample("py", 'k‹import› i‹x›\ni‹MAX{k}› o‹=› l‹3›\no‹@›i‹dec›\nk‹class› i‹A{k}›p‹(›i‹B›p‹)›p‹:›\n    k‹def› i‹m{k}›p‹(›i‹self›p‹)›p‹:›\n        k‹return› l‹rb\'x\'› o‹+› l‹f"y"›  c‹# c›\nk‹def› i‹g›p‹(›i‹a›p‹,›\n  i‹b›p‹)›p‹:›\n    l‹"""doc"""›\n', """
MAX{k}|constant|constant||2|4
A{k}|type|class||5|22
m{k}|method|method||13|22
g|function|function||24|32
"""),
    "r": Sample("r", """c‹# c›
i‹f{k}› o‹<›o‹-› k‹function›p‹(›i‹x›p‹)› p‹{› i‹x› o‹+› l‹r"(a"b)"› p‹}›
i‹g{k}› o‹=› k‹function›p‹(›p‹)› l‹'y'›
""", """
f{k}|function|function||1|12
g{k}|function|function||13|18
"""),
    "rpg": Sample("rpgle", """o‹*›o‹*›i‹FREE›
k‹dcl-s› i‹x{k}› i‹int›p‹(›l‹10›p‹)›p‹;› c‹// c›
k‹dcl-proc› i‹foo{k}›p‹;›
  k‹return› l‹'a''b'›p‹;›
k‹end-proc›p‹;›
""", """
x{k}|variable|standalone||3|9
foo{k}|function|procedure||11|17
"""),
    "rust": Sample("rs", """c‹// top›
k‹use› i‹a›p‹:›p‹:›i‹b›p‹;›
k‹pub› k‹struct› i‹S{k}› p‹{› i‹x›p‹:› i‹u32› p‹}›
k‹impl› i‹S{k}› p‹{›
  k‹pub› k‹fn› i‹m{k}›p‹(›o‹&›k‹self›p‹)› o‹-›o‹>› i‹u32› p‹{› k‹let› i‹y› o‹=› l‹r#"q"#›p‹;› l‹1.5› p‹}›
p‹}›
k‹enum› i‹E{k}› p‹{› i‹A›p‹,› i‹B›p‹(›i‹u8›p‹)›p‹,› i‹C› o‹=› l‹3› p‹}›
k‹mod› i‹t› p‹{› k‹const› i‹K{k}›p‹:› i‹u8› o‹=› l‹b'x'›p‹;› p‹}› c‹/* a /* b */ c */›
""", """
S{k}|type|struct||7|14
S{k}|other|impl||15|36
m{k}|method|fn||18|35
y|variable|let||29|33
E{k}|type|enum||37|50
A|constant|variant||40|40
B|constant|variant||42|45
C|constant|variant||47|49
t|module|mod||51|61
K{k}|constant|const||54|60
"""),
    "scala": Sample("scala", 'k‹package› i‹a{k}›\nk‹object› i‹O{k}› p‹{›\n  k‹def› i‹f›p‹(›i‹x›p‹:› i‹Int›p‹)› o‹=› i‹x›\n  k‹val› i‹v{k}› o‹=› l‹"""q"""›\np‹}›\nk‹case› k‹class› i‹C{k}›p‹(›i‹a›p‹:› i‹Int›p‹)›\n', """
a{k}|module|package||0|26
O{k}|module|object||2|18
f|function|def||5|13
v{k}|variable|val||14|17
C{k}|type|case class||19|26
"""),
    "shell": Sample("sh", """c‹#!/bin/sh›
i‹export› i‹A{k}›o‹=›l‹1›
i‹f{k}›p‹(›p‹)› p‹{›
  i‹echo› l‹"a $(g "b")"› i‹$A› i‹${B:-c}› c‹# d›
p‹}›
i‹cat› o‹<<E›
l‹x
E›
i‹readonly› i‹R{k}›o‹=›l‹'s'›
""", """
A{k}|variable|export||1|4
f{k}|function|function||5|14
R{k}|constant|readonly||18|21
"""),
    "sql": Sample("sql", """c‹-- c›
k‹CREATE› k‹TABLE› i‹dbo›p‹.›i‹[T {k}]› p‹(›i‹a› i‹int›p‹,› i‹b› i‹varchar›p‹)›p‹;›
k‹CREATE› k‹OR› i‹REPLACE› k‹VIEW› i‹v{k}› k‹AS› k‹SELECT› l‹'it''s'› k‹AS› i‹"q"› k‹FROM› i‹t›p‹;›
k‹create› k‹index› i‹i{k}› k‹on› i‹t›p‹(›i‹a›p‹)›p‹;› c‹/* z */›
""", """
dbo.T {k}|type|table||1|13
v{k}|type|view||14|26
i{k}|other|index||27|35
"""),
    "typescript": Sample("ts", """i‹interface› i‹I{k}› p‹{› i‹a›p‹:› i‹string› p‹}›
i‹abstract› k‹class› i‹K{k}› p‹{› i‹private› i‹x›p‹:› i‹number› o‹=› l‹1›p‹;› p‹}›
k‹enum› i‹E{k}› p‹{› i‹A›p‹,› i‹B› o‹=› l‹1› o‹<›o‹<› l‹2›p‹,› l‹'c-d'› o‹=› l‹'x'› p‹}›
i‹namespace› i‹N› p‹{› k‹export› k‹function› i‹q{k}›p‹(›p‹)›p‹:› k‹void› p‹{›p‹}› p‹}›
""", """
I{k}|type|interface||0|6
a|variable|field||3|5
K{k}|type|abstract_class||7|18
x|variable|field||11|17
E{k}|type|enum||19|34
A|constant|enum_member||22|22
B|constant|enum_member||24|29
c-d|constant|enum_member||31|33
N|module|namespace||35|47
q{k}|function|function||38|46
"""),
}
