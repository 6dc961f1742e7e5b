"""Source files in several languages, written for the checks; <K> and <S> come from `part`."""

PYTHON = '''import os
import sys as y
from typing import (
    List,
    Dict as D,
)

@register
class P<K>:
    """Doc of
    def hidden(self):
    """
    @cached
    def price(
        self,
    ) -> float:
        return os.x(<S>)

    def name(self):  # not def other():
        text = "def fake(): {"
        return y.n(D, <S>)

def free<K>():
    import math
    return math.sqrt(<S>)
'''

SCRIPT = '''import def, { one as o<K>, two } from "./lib";
import * as ns from "ns";

export class P<K> {
  constructor(a) {
    this.a = "{ not a brace";
  }
  /* block
     { comment } {
  */
  price() {
    if (two(<S>)) { return ns.x; } else {
      return o<K>.call(<S>);
    }
  }
}

function free<K>() { return 0; }
export function last() {
  return two(<S>);
}
'''

JAVA = '''package p;
import java.util.List;
import static java.lang.Math.max;

public class P<K> {
    private int a = <S>;

    public List<String> price(int q)
    {
        return max(a, q); // }
    }

    int name() { return 1; }
}
'''

GO = '''package p

import (
\t"fmt"
\tm "math"
)
import "os"

type P<K> struct {
\ta int
}

func (p *P<K>) Price() float64 {
\ts := "}"
\treturn m.Sqrt(<S>)
}

func free<K>() { fmt.Println(os.Args) }
'''

RUST = '''use std::io::{self, Read};
use std::fmt;

pub struct P<K> {
    a: u32,
}

impl P<K> {
    pub fn price<A>(&self) -> u32 {
        let c = "{";
        fmt::x(<S>)
    }
}

fn free<K>() -> u32 {
    io::y(<S>)
}
'''

# Which sample a part gets: its key modulo the number of entries.
FILES = [
    ("py", PYTHON), ("js", SCRIPT), ("ts", SCRIPT), ("java", JAVA), ("go", GO), ("rs", RUST), ("cpp", JAVA),
]

# Expected by reading the samples: (language, first line, statement, names).
IMPORTS = [
    ("python", 0, "import os", ["os"]),
    ("python", 1, "import sys as y", ["y"]),
    ("python", 2, "from typing import (\n    List,\n    Dict as D,\n)", ["List", "D"]),
    ("python", 23, "import math", ["math"]),
    *[
        (script, line, text, names)
        for script in ("javascript", "typescript")
        for line, text, names in [
            (0, 'import def, { one as o<K>, two } from "./lib";', ["def", "o<K>", "two"]),
            (1, 'import * as ns from "ns";', ["ns"]),
        ]
    ],
    ("java", 1, "import java.util.List;", ["List"]),
    ("java", 2, "import static java.lang.Math.max;", ["max"]),
    ("go", 2, 'import (\n\t"fmt"\n\tm "math"\n)', ["fmt", "m"]),
    ("go", 6, 'import "os"', ["os"]),
    ("rust", 0, "use std::io::{self, Read};", ["io", "Read"]),
    ("rust", 1, "use std::fmt;", ["fmt"]),
]

# Expected by reading the samples: (language, kind, first line, last line, signature).
SCOPES = [
    ("python", "class", 8, 21, "@register\nclass P<K>:"),
    ("python", "function", 13, 17, "    @cached\n    def price(\n        self,\n    ) -> float:"),
    ("python", "function", 18, 21, "    def name(self):  # not def other():"),
    ("python", "function", 22, 25, "def free<K>():"),
    *[
        (script, *scope)
        for script in ("javascript", "typescript")
        for scope in [
            ("class", 3, 15, "export class P<K> {"),
            ("function", 4, 6, "  constructor(a) {"),
            ("function", 10, 14, "  price() {"),
            ("function", 17, 17, "function free<K>() { return 0; }"),
            ("function", 18, 20, "export function last() {"),
        ]
    ],
    ("java", "class", 4, 13, "public class P<K> {"),
    ("java", "function", 7, 10, "    public List<String> price(int q)\n    {"),
    ("java", "function", 12, 12, "    int name() { return 1; }"),
    ("go", "class", 8, 10, "type P<K> struct {"),
    ("go", "function", 12, 15, "func (p *P<K>) Price() float64 {"),
    ("go", "function", 17, 17, "func free<K>() { fmt.Println(os.Args) }"),
    ("rust", "class", 3, 5, "pub struct P<K> {"),
    ("rust", "function", 8, 11, "    pub fn price<A>(&self) -> u32 {"),
    ("rust", "function", 14, 16, "fn free<K>() -> u32 {"),
]

# Ignore file of each repository; `{extra}` depends on the number of the source.
IGNORE_FILE = """# build output
build/
  *.log\t

docs/*/f?2*
!f2.md
/src
pkg/_priv
[ab].py
f4[0-4]*.c
f[!0-8]5.*
*.tar.?z/
[]*
[!]
f[]?*
{extra}
"""
EXTRA_PATTERNS = ["f1*", "*f7?"]

# The same patterns by hand: (kind, pattern, bare form, whole-name regex, source parity or None).
PATTERNS = [
    ("literal", ".git", ".git", None, None),
    ("glob", ".git/**", ".git/**", r"\.git/.*", None),
    ("literal", "uv.lock", "uv.lock", None, None),
    ("dir", "build/", "build", None, None),
    ("glob", "*.log", "*.log", r".*\.log", None),
    ("glob", "docs/*/f?2*", "docs/*/f?2*", r"docs/.*/f.2.*", None),
    ("literal", "!f2.md", "!f2.md", None, None),
    ("literal", "/src", "/src", None, None),
    ("literal", "pkg/_priv", "pkg/_priv", None, None),
    ("literal", "[ab].py", "[ab].py", None, None),
    ("glob", "f4[0-4]*.c", "f4[0-4]*.c", r"f4[0-4].*\.c", None),
    ("glob", "f[!0-8]5.*", "f[!0-8]5.*", r"f[^0-8]5\..*", None),
    ("dir", "*.tar.?z/", "*.tar.?z", r".*\.tar\..z", None),
    ("glob", "[]*", "[]*", r"\[\].*", None),
    ("literal", "[!]", "[!]", None, None),
    ("glob", "f[]?*", "f[]?*", r"f\[\]..*", None),
    ("glob", "f1*", "f1*", r"f1.*", 0),
    ("glob", "*f7?", "*f7?", r".*f7.", 1),
]


# Lines with strings, comments and templates over several lines, and what a lexer finds in them:
# (extension, [(repeated, line, code, starts inside, depth before the i-th of them)]). A repeated
# line stands d times, d nested levels. <K> comes from `part`.
LEXEMES = [
    (".ts", [
        (False, "function f<K>() {", "function f<K>() {", False, "0"),
        (False, "  const a = `open { \" '", "  const a = ", False, "1"),
        (True, "} ${ h({ `{", " h({ ", True, "i"),
        (True, "' /* ` }) } \"", " }) ", True, "d + 2 - i"),
        (False, "`; // end `{", "; ", True, "1"),
        (False, "  /* ' ` { */ return /[`{'/]/.test(a) ? 1 : 2;", "   return .test(a) ? 1 : 2;", False, "1"),
        (False, "}", "}", False, "1"),
    ]),
    (".rs", [
        (False, "fn f<K><'a>(x: &'a str) {", "fn f<K><'a>(x: &'a str) {", False, "0"),
        (True, "/* { \" ' ", "", "i > 1", "1"),
        (True, "} */", "", True, "1"),
        (False, "  let c = '{'; let s = r#\"{ \" }", "  let c = ; let s = ", False, "1"),
        (False, "} /* \"# ; }", " ; }", True, "1"),
    ]),
    (".py", [
        (False, "class P<K>:", "class P<K>:", False, "0"),
        (False, "    '''doc \"\"\" {", "    ", False, "0"),
        (True, "  def hidden(): {", "", True, "0"),
        (False, "    ''' # ''' {", " ", True, "0"),
        (False, "    x = \"# {\" + '\\'' # {", "    x =  +  ", False, "0"),
        (False, "    y = 'a \\", "    y = ", False, "0"),
        (False, "  { b' + z", " + z", True, "0"),
    ]),
    (".java", [
        (False, "class C<K> {", "class C<K> {", False, "0"),
        (False, "  String s = \"\"\"", "  String s = ", False, "1"),
        (True, "  { \\\"\"\" \" /* ", "", True, "1"),
        (False, "  \"\"\" + '\"' + \"// {\"; /* {", " +  + ; ", True, "1"),
        (False, "  } */ int x;", " int x;", True, "1"),
        (False, "}", "}", False, "1"),
    ]),
]
