from __future__ import annotations

from faultlines.plans import analysis
from faultlines.sources.logs import LOG_SCHEMA

GOLDEN = {
    "dotnet.mixed": (
        "BuildLog",
        "Build started...\n"
        "Program.cs(14,9): error CS0103: The name 'builderz' does not exist in the current context\n"
        "Models/User.cs(8,19): warning CS8618: Non-nullable property 'Name' must contain a non-null value when exiting "
        "constructor. Consider adding the 'required' modifier or declaring the property as nullable.\n"
        'error MSB3021: Unable to copy file "obj\\Debug\\net9.0\\apphost.exe" to "bin\\Debug\\net9.0\\MyApp.exe". The process '
        "cannot access the file because it is being used by another process.\n"
        "Build FAILED.\n    1 Warning(s)\n    2 Error(s)\nTime Elapsed 00:00:01.42\n",
    ),
    "dotnet.single": (
        "SingleDiagnostic",
        "Program.cs(14,9): error CS0103: The name 'builderz' does not exist in the current context",
    ),
    "tsc.single": ("SingleDiagnostic", "src/app.ts:5:13 - error TS2304: Cannot find name 'usre'."),
    "python.name": (
        "BuildLog",
        'Traceback (most recent call last):\n  File "src/main.py", line 8, in <module>\n    run()\n'
        '  File "src/main.py", line 5, in run\n    print(usre_name)\nNameError: name \'usre_name\' is not defined\n',
    ),
    "npm.script": (
        "BuildLog",
        'npm ERR! Missing script: "build"\nnpm ERR!\nnpm ERR! To see a list of scripts, run:\nnpm ERR!   npm run\n'
        "npm ERR! A complete log of this run can be found in: C:\\npm-cache\\debug-0.log\n",
    ),
    "vite.import": (
        "BuildLog",
        "vite v5.4.8 building for production...\ntransforming...\n✓ 3 modules transformed.\nx Build failed in 112ms\n"
        'error during build:\n[vite]: Rollup failed to resolve import "axiosx" from "/src/main.ts".\n'
        "This is most likely unintended because it can break your application at runtime.\n"
        "    at viteWarn (file:///workspace/app/node_modules/vite/dist/node/chunks/dep.js:123:45)\n",
    ),
}


def logs(spark, contents: dict[str, str], input_type: str = "BuildLog", hint: str | None = None):
    rows = [(k, v, input_type, hint, "proj", "repo", None, True, False) for k, v in contents.items()]
    return spark.createDataFrame(rows, LOG_SCHEMA)


def golden_logs(spark):
    rows = [(k, text, kind, None, "proj", "repo", None, True, False) for k, (kind, text) in GOLDEN.items()]
    return spark.createDataFrame(rows, LOG_SCHEMA)


def parse(spark, content: str, hint: str | None = None):
    """Segment rows of one log, in order."""
    return analysis.extracted(logs(spark, {"x": content}, hint=hint)).orderBy("seg").collect()
