"""A small code corpus for operators that read source files, written for this repository."""

FILES = [
    ("src/app/main.py", "from app import store\nimport os, json\n\n\ndef main(argv):\n    data = load(argv)\n    # TODO: handle urgent errors -- ana\n    return run(data)\n\n\nasync def load(path):\n    return parse(path)\n\n\ndef parse(text):\n    return text.split()\n\n\ndef run(data):\n    if data and len(data) > 3:\n        run(data[1:])\n    return os.environ['APP_TOKEN']\n"),
    ("src/app/store.py", "import json\n\n\ndef parse(text):\n    return json.loads(text)\n\n\nclass Store:\n    def get(self, key):\n        return eval(key)\n\n\ndef main():\n    # FIXME later clean up\n    return parse('{}')\n"),
    ("tests/test_main.py", "from app.main import main\n\n\ndef test_main():\n    assert main([])\n\n\ndef test_parse():\n    assert parse('a b')\n"),
    ("web/index.js", "import {render} from './view'\nconst api = require('axios')\n\nfunction start(root) {\n  // HACK maybe drop this\n  render(root)\n  stop(root)\n}\n\nexport const stop = async (root) => {\n  root.innerHTML = '<b>' + root.id\n}\n\nconst key = process.env.API_KEY\n"),
    ("web/view.ts", "export function render(root: any): void {\n  if (root) { for (;;) { while (true) { paint(root) } } }\n}\n\nexport const paint = (root: any) => {\n  return root\n}\n"),
    ("web/view.test.ts", "import {render} from './view'\n\ndescribe('view', () => {\n  it('renders', () => { render(null) })\n})\n"),
    ("core/Main.java", "package com.example.core;\n\nimport java.util.List;\nimport com.example.util.Text;\n\npublic class Main {\npublic static void main(String[] args) {\n    List<String> xs = Text.split(args[0]);\n    /** NOTE important entry */\n}\n}\n"),
    ("core/MainTest.java", "package com.example.core;\n\npublic class MainTest {\n@Test\npublic void works() {\n    Main.main(null);\n}\n}\n"),
    ("native/io.c", "#include <stdio.h>\n#define LIMIT 64\n\nstatic int read_all(char *path) {\n    return parse_line(path);\n}\n\nint parse_line(char *s) {\n    return s[0] == '{';\n}\n"),
    ("native/io.cpp", "#include \"io.h\"\n\nReader::read(char *p) {\n    return p;\n}\n"),
    ("svc/server.go", "package main\n\nimport \"net/http\"\n\nfunc (s *Server) Handle(w http.ResponseWriter) {\n\ts.log(w)\n}\n\nfunc main() {\n\tserve(nil)\n}\n"),
    ("svc/lib.rs", "use std::fmt;\nuse crate::io::Reader;\n\npub fn open(path: &str) -> Reader {\n    Reader::new(path)\n}\n\npub async fn close(r: Reader) {\n}\n"),
]

MANIFESTS = [
    ("a/package.json", '{"name": "shop", "version": "1.2.0", "scripts": {"build": "tsc", "test": "jest"}, "dependencies": {"react": "^18.2.0", "axios": "1.6.0"}, "devDependencies": {"typescript": "~5.1.0", "jest": "^29.0.0"}}'),
    ("b/package.json", '{"name": "tools", "version": "0.1.0", "dependencies": {"axios": "0.27.0", "vue": "^3.0.0"}}'),
    ("a/package-lock.json", '{"packages": {"node_modules/react": {"version": "18.2.0"}, "node_modules/@types/node": {"version": "20.1.0", "dev": true}, "node_modules/fsevents": {"version": "2.3.0", "optional": true}, "node_modules/axios": {"version": "1.6.0", "peer": true}}}'),
    ("c/requirements.txt", "requests>=2.28.0\n# comment\nflask==2.3.2\nnumpy\npandas~=2.0\n\n-r other.txt\n"),
    ("c/pyproject.toml", '[project]\nname = "sample"\nversion = "0.3.1"\ndescription = "A sample"\n'),
    ("d/Cargo.toml", '[package]\nname = "engine"\nversion = "0.9.0"\nedition = "2021"\n\n[dependencies]\nserde = "1.0"\ntokio = { version = "1.28", features = ["full"] }\n\n[dev-dependencies]\ncriterion = "0.5"\n'),
    ("d/Cargo.lock", '[[package]]\nname = "serde"\nversion = "1.0.160"\n\n[[package]]\nname = "tokio"\nversion = "1.28.0"\n'),
    ("e/go.mod", "module example.com/svc\n\ngo 1.21\n\nrequire (\n\tgithub.com/gin-gonic/gin v1.9.1\n\tgolang.org/x/text v0.9.0 // indirect\n)\n"),
    ("e/go.sum", "github.com/gin-gonic/gin v1.9.1 h1:abc=\ngithub.com/gin-gonic/gin v1.9.1/go.mod h1:def=\ngolang.org/x/text v0.9.0 h1:ghi=\n"),
    ("f/pom.xml", "<project><groupId>com.example</groupId><artifactId>web</artifactId><version>2.0</version><dependencies><dependency><groupId>org.springframework.boot</groupId><artifactId>spring-boot-starter</artifactId><version>3.1.0</version></dependency><dependency><groupId>junit</groupId><artifactId>junit</artifactId><version>4.13</version></dependency></dependencies></project>"),
    ("g/build.gradle", "plugins {\n    id 'com.android.application' version '8.0.0'\n}\nandroid {\n    compileSdk 34\n    defaultConfig {\n        minSdk 24\n        targetSdk 34\n    }\n}\ndependencies {\n    implementation 'androidx.core:core-ktx:1.10.0'\n    testImplementation \"junit:junit:4.13.2\"\n}\n"),
    ("h/CMakeLists.txt", "cmake_minimum_required(VERSION 3.16)\n# comment\nproject(Demo VERSION 1.4.0 LANGUAGES CXX)\nfind_package(OpenSSL REQUIRED)\nadd_executable(demo main.cpp)\nadd_library(util STATIC util.cpp)\n"),
    ("i/AndroidManifest.xml", '<manifest package="com.example.app"><uses-permission android:name="android.permission.INTERNET"/><application><activity android:name=".MainActivity"/><service android:name=".Sync"/></application></manifest>'),
    ("j/board.dts", 'compatible = "vendor,board", "vendor,soc";\nmodel = "Board One";\nuart0: serial@101f1000 {\n  compatible = "arm,pl011";\n};\n'),
    ("k/.config", "CONFIG_ARM=y\nCONFIG_SMP=y\n# CONFIG_DEBUG is not set\nCONFIG_USB=m\nCONFIG_HZ=250\n"),
    ("l/link.ld", "ENTRY(Reset_Handler)\nMEMORY\n{\n  FLASH (rx) : ORIGIN = 0x08000000, LENGTH = 512K\n  RAM (rwx) : ORIGIN = 0x20000000, LENGTH = 128K\n}\n"),
    ("m/FreeRTOSConfig.h", "#define configUSE_PREEMPTION 1\n#define configTICK_RATE_HZ 1000\n#define configMAX_PRIORITIES 5\n"),
    ("n/.github/workflows/ci.yml", "name: ci\non: [push, pull_request]\njobs:\n  test:\n    runs-on: ubuntu-latest\n    env:\n      KEY: ${{ secrets.API_KEY }}\n  deploy:\n    runs-on: ubuntu-latest\n    env:\n      A: ${{ secrets.DEPLOY_KEY }}\n      B: ${{ secrets.API_KEY }}\n"),
    ("o/.gitlab-ci.yml", "stages:\n  - build\n  - test\nunit:\n  stage: test\n  script: make test\npack:\n  stage: build\n  script: make\n"),
    ("p/Jenkinsfile", "pipeline {\n  agent any\n  stages {\n    stage('Build') { steps { sh 'make' } }\n    stage('Test') { steps { sh 'make test' } }\n  }\n}\n"),
    ("q/.env", "# settings\nDEBUG=1\nDB_PASSWORD='hunter22'\nNAME=demo\nNAME=shop\nexport API_KEY=abcdefgh\n"),
    ("r/yarn.lock", 'react@^18.2.0:\n  version "18.2.0"\n  resolved "x"\n\naxios@1.6.0:\n  version "1.6.0"\n'),
    ("s/Android.mk", "LOCAL_PATH := $(call my-dir)\nLOCAL_MODULE := codec\nLOCAL_SRC_FILES := a.c b.c\n"),
    ("t/prj.conf", "CONFIG_GPIO=y\nCONFIG_MAIN_STACK_SIZE=2048\n"),
]

#: Small projects of several kinds (project, path, content), paths relative to the project.
PROJECTS = [
    ("py", "src/main.py", "def main():\n    print('hello')\n"),
    ("py", "requirements.txt", "requests>=2.28.0\npytest>=7.0.0\n"),
    ("py", "pyproject.toml", '[project]\nname = "sample"\nversion = "0.1.0"\n'),
    ("droid", "app/src/main/AndroidManifest.xml", '<manifest package="com.example.app"/>'),
    ("droid", "build.gradle", "plugins { id 'com.android.application' }\n"),
    ("droid", "app/src/main/java/com/example/MainActivity.kt", "class MainActivity\n"),
    ("native", "CMakeLists.txt", "project(TestProject VERSION 1.0.0 LANGUAGES CXX)\n"),
    ("native", "src/main.cpp", "int main() { return 0; }\n"),
    ("web", "package.json", '{"name": "app", "dependencies": {"react": "^18.2.0"}}'),
    ("web", "tsconfig.json", "{}"),
    ("web", "src/main.tsx", "export const App = () => null\n"),
    ("desk", "package.json", '{"name": "desk", "devDependencies": {"electron": "28.0.0"}}'),
    ("desk", "app.js", "require('electron')\n"),
    ("car", "vehicle/main.cpp", "int main() {}\n"),
    ("car", "hud/main.c", "int main() {}\n"),
    ("car", "services/log/main.py", "pass\n"),
    ("car", "ipc/IStore.aidl", "interface IStore { void put(int k); }\n"),
    ("car", "ipc/someip/log.proto", "service Log { rpc Put(A) returns (B); }\n"),
    ("board", "board.dts", "/ { };\n"),
    ("board", "board.dtsi", "/ { };\n"),
    ("board", "firmware.ioc", "x=1\n"),
    ("none", "notes.txt", "nothing\n"),
]
