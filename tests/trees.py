"""A small source tree with every supported format, written for these tests."""

from __future__ import annotations

from pathlib import Path

TREE = {
    "BUILD.bazel": 'cc_library(name = "base", srcs = ["a.cc"])\ncc_binary(\n    name = "tool",\n    deps = [":base", "//ext:z"],\n)\n',
    "CMakeLists.txt": "project(x)\nadd_library(base a.c)\nadd_executable(tool m.c)\ntarget_link_libraries(tool PRIVATE base m)\n",
    "Dockerfile": (
        "FROM python:3.12 AS builder\nRUN make\nFROM debian:12\nARG X=1\nCOPY --from=builder /w /w\n"
        "COPY --chown=a:b out/app.tar.gz conf/ \\\n  /srv/\nADD one.zip /x\nFROM ${BASE}\n"
    ),
    "Jenkinsfile": (
        "pipeline {\n  stages {\n    sh 'early ignored'\n    stage('Compile') {\n      steps {\n        sh 'make all'\n"
        "      }\n    }\n    stage(\"Ship\") {\n      sh \"python tools/ship.py --input out/app.tar.gz\"\n    }\n  }\n}\n"
    ),
    "Makefile": (
        "OUT := out\n\nall: lib docs/index.md $(EXTRA) # note\n\t@bash tools/pack.sh\n\tpython tools/build.py \\\n"
        "\t  --output out/app.tar.gz\n\nlib test: %.o\nifeq ($(X),1)\n\t-echo one\nelse\n\tmake all\nendif\n\n%.o: %.c\n\tcc -c $<\n"
    ),
    "compose.yaml": (
        "services:\n  web:\n    image: acme/web:1\n    depends_on:\n      db: {condition: ok}\n      cache: {}\n  db:\n    image: postgres:16\n"
        "  cache: null\n  api:\n    depends_on: [web, db]\n"
    ),
    ".github/workflows/ci.yml": (
        "name: Main CI\non: [push]\njobs:\n  lint:\n    steps:\n      - uses: actions/checkout@v4\n      - name: Run Lint\n        run: |\n"
        "          set -e\n          bash tools/lint.sh && MODE=ci python tools/check.py --report out/r.json\n"
        "  deploy:\n    needs: lint\n    steps:\n      - id: go\n        run: docker push acme/web\n      - run: npm run build\n"
        "  audit:\n    needs: [lint, deploy]\n    steps: none\n"
    ),
    ".gitlab-ci.yml": (
        "stages: [a]\nimage: x\nvars: 1\nbuild:\n  script: make all\ndeploy:\n  needs:\n    - job: build\n    - build\n    - {}\n  script:\n    - bash go.sh\n    - 7\n"
    ),
    "docs/guide.md": (
        "# Guide\n\nSee [setup](setup.md#intro), [up](../README.md), [site](https://x.org), [mail](mailto:a@b.c) and ![pic](p.png).\n"
        "A [named][ref] link, [ref] again and [anchor](#here).\n\n[ref]: <other file.md> \"t\"\n\n- grep\n- terminal\n- two words\n- `inline`\n\n"
        "Use `fooBar` or `ab` or `a/b` or `x y`.\n\n```sh\n[hidden](no.md) `notool`\n```\n\n    [code](no2.md)\n"
    ),
    "docs/setup.md": "Setup\n=====\nHow to install things.\n\n## Empty\n## Calibration\nCalibrating the nations of models.\n",
    "tools/pack.sh": (
        "#!/bin/sh\nMODEL_OUT=models/m.ckpt\nsource ./env.sh\npython tools/build.py --output out/app.tar.gz\ncat <<EOF\nbash not_me.sh\nEOF\n"
        "for f in a b; do bash \"sub/$f.sh\"; done\n"
    ),
    "src/app.py": (
        "from __future__ import annotations\nimport json as j, os.path\nfrom .util import helper\nfrom . import x\n\n\n"
        "@deco(1)\nclass App(Base):\n    def run(self):\n        helper().go(j.dumps({}))\n\n    async def stop(self):\n        pass\n\n\ndef main():\n    App().run()\n\n\nmain()\n"
    ),
    "src/web.ts": (
        "import { join } from 'path';\nimport fs from \"fs\";\nconst helper = require('./helper'); // import('no')\n/* call(x)\n*/\n"
        "export function boot(): void {\n  execute();\n  if (x) { join('a(', \"b\"); }\n}\n\nexport class Router extends Base {\n  async run(a: number): Promise<void> {\n"
        "    boot();\n    new Widget(1);\n  }\n}\n\nconst execute = (a) => {\n  helper.read('x');\n};\nboot();\n"
    ),
    "src/lib.go": 'package x\n\nimport (\n\t"fmt"\n\tz "os/exec"\n)\n\ntype T struct{}\n\nfunc (t *T) Do(a int) error {\n\tfmt.Println("x()")\n\treturn nil\n}\n\nfunc Top() { new(T).Do(1) }\n',
    "src/lib.rs": "use std::fs::{self, File};\n\nstruct P;\n\ntrait Q { fn sig(&self); }\n\nimpl P {\n    fn go(&self) {\n        println!(\"{}\", 1);\n        fs::read(\"a\");\n    }\n}\n",
    "src/Main.java": "package a;\nimport java.util.List;\nimport static org.x.Y.*;\n\npublic class Main {\n  public Main() { init(); }\n  void run(String a) throws E {\n    new Helper().go();\n  }\n}\ninterface I { int size(); }\n",
    "src/native.cpp": "#include <vector>\n#include \"a.h\"\n\nint add(int a, int b) {\n  return helper::sum(a, b);\n}\nvoid ns::C::go() const {\n  if (x) { obj->call(); }\n}\n",
    "src/bad.py": "def ok():\n    pass\nclass (:\n",
    "node_modules/skip.py": "import never\n",
    ".hidden/skip.py": "import hush\n",
    "README.md": "hello\n",
}


def write_tree(root: Path, tree: dict[str, str] = TREE) -> Path:
    for name, text in tree.items():
        target = Path(root, name)
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text, encoding="utf-8")
    return Path(root)
