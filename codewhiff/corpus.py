"""Source files made of the documents table: each document becomes the end of a file that begins with one of these snippets.

The tables hold prose; the snippets give every rule hits, suppressed hits and near misses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime


def _filled(n: int, line: str) -> str:
    return "\n".join([line] * n)


SNIPPETS: tuple[tuple[str, str], ...] = (
    ("ts", 'const api_key = "q8ZsW3vT0rLmN4xKc7"\nlet password: string\nconst secret = \'short\'\nconst token = process.env.T || "q8ZsW3vT0rLmN4xKc7"'),
    ("js", "const r = eval(input)\nconst f = new Function('a', body)\nreevaluate(x)\neval (y) // safe\nmedieval(z)"),
    ("tsx", "el.innerHTML = raw\nel.innerHTML == raw\n<div dangerouslySetInnerHTML={h} />\nel.innerHTML = DOMPurify.sanitize(raw)"),
    ("mjs", "db.query(`SELECT * FROM t WHERE id = ${id}`)\ndb.query(\"delete from t where n = '\" + n)\nconst s = 'selection ' + n\nq = ' update t set a=' + v"),
    ("js", "load().then(show)\nload().then(x => show(x)) ;\nload().then(show).catch(report)\nload().then(show).finally(close)\nconst p = new RegExp('a').then(b)\nload().then(\n  show)"),
    ("jsx", "console.log('here')\n  console.debug (state)\nconsole.error(e)\nconsole.info(x) // keep\nlogger.wrap(console.log(x))"),
    ("ts", "// TODO: implement the cache\n/* FIXME handle overflow */\n * hack replace later\n// TODO call Anna\n# XXX: setup"),
    ("cjs", "// increment the counter\ni++ // set a value\n// return result because callers rely on it\n// get the name TODO\n// Loop items  "),
    ("tsx", "let a: any = b\nconst c = d as any\nreturn <any>e\nlet g: anyone\nlet h: any // safe\n// @ts-ignore x: any"),
    ("py", "x = 1  # this should work\n# not sure if needed noqa\n# Hopefully fine\n# probably the best\n# probably not right\n# this may need care\n# I'm not certain\n# replace this with your actual key"),
    ("js", "// i'm not sure\n// this might require more\n// It should work, @ts-ish\n// might nothing\n/* hopefully */"),
    ("py", "# Step 1: read\n# step 22 - write\n# step three: x\n# Step 3. see README\n# step 4"),
    ("ts", "// ======\n//-----~~~***\n// ====\n// ---------- license\n# ######"),
    ("js", "function a() { throw new Error('not implemented') }\nthrow new Error(\"TODO\")\nthrow new Error('todo later')\nthrow new Error('stub') // in tests\nthrow  new  Error ( 'implement  this' )"),
    ("ts", "// This function handles input\n// this class is used for io\n// this method processes\n// this hook process\n// This module returns x @returns\n// this component does it"),
    ("ts", "app.get('/a', async (req, res) => {\nrouter.post('/b', async function (req, res) {\n})\napp.put('/c', wrapAsync(async (q) => q))\napp.delete('/d', m, async (q) => q)\napp.patch('/e', handler)\n})"),
    ("jsx", "app.get('/a', async (req, res) => 1)\nres.json({ e: err.message })\nres.status(500).send(error.stack)\nres.send(err.toString())\nres.json(ok)\nres.status(400).json({ error: 'bad' })"),
    ("py", "eval(code)\nexec (code)\nos.system('ls')\nsubprocess.run(cmd, shell=True)\nsubprocess.Popen(cmd)\nast.literal_eval(x)\neval(x)  # nosec\ncur.execute(q)"),
    ("py", "q = f\"SELECT {x}\"\nq = 'insert into t values ({})'.format(x)\nq = f'selected {x}'\nq = f'DELETE {x}'  # noqa\nq = \"drop table\""),
    ("py", "try:\n    go()\nexcept:\n    pass\ntry:\n    go()\nexcept ValueError:\n    # fine\n    pass\ntry:\n    go()\nexcept KeyError as e:\n    pass\n    log(e)\nexcept OSError: pass  # gone\nexcept (A, B): pass\nexcept :  # noqa\n\n  pass"),
    ("py", "from os import *\nfrom a.b import  *\n from c import *\nfrom d import *  # noqa\nfrom e import f"),
    ("py", "def a(x=[]): return x\ndef b(x, y={ }, z=set()): pass\ndef c(x=field(default=[])): pass\ndef d(x=None, y=()): pass\ndef e(x=[1]): pass"),
    ("py", "print('x')\nif __name__ == '__main__': print(1)\npprint(x)\nprint (y)  # keep\nprint(z)  # debug\nblueprint(q)"),
    ("py", "app.run(debug=True)\napp.run(host='a', debug = True)\nif __name__ == '__main__': app.run(debug=True)\napp.run(debug=False)"),
    ("py", "# set the value\n# get a name\n# loop over all of them\n# check result  NOTE\n# NOTE: save x\n# import numpy"),
    ("py", "raise NotImplementedError()\nraise NotImplementedError\nraise NotImplementedError('')\nraise NotImplementedError('later')\nraise NotImplementedError()  # abstract"),
    ("py", "x = f()  # type: ignore\ny = g()  # type: ignore[arg]\nz = h()  #type:ignore  \n# type: ignored"),
    ("ts", "import a from 'jwt-decode-utils'\nimport b from 'jwt-decode'\nconst c = require(\"node-cron-scheduler\")\nexport { d } from '@openai/api'\nimport 'next-auth-prisma'\nimport e from '@langchain/agents/x'\nimport f from 'node-cron-scheduler' // x\nawait import ( `vite-plugin-react-swc-refresh` )"),
    ("py", "import pandas_profiler\nfrom langchain-memory.x import y\nimport os, chromadb_utils\n# import anthropic_sdk\nimport flask_cors_headers_more\n  import pinecone_utils, os"),
    ("js", "try { a() } catch (e) {}\ntry { a() } catch { }\ntry {\n  a()\n} catch (e) {\n\n}\ntry {\n  a()\n} catch (e) {\n  // TODO later\n}\ntry {\n  a()\n} catch (e) {\n  // quiet\n}\ntry { a() } catch (e) { b() }\n} catch (e) { x } }"),
    ("ts", "try {\n  a()\n} catch (e) {\n  console.error(e)\n}\ntry {\n  a()\n} catch (e) {\n  console.log(e)\n  // and on\n  console.warn('w')\n}\ntry {\n  a()\n} catch (e) {\n  console.error(e)\n  throw e\n}\ntry { a() } catch (e) { console.log(e) }\ntry { a() } catch (e) { console.log(e); throw e }\ntry { a() } catch (e) { b(); console.log(e) }"),
    ("js", "if (a) {\n if (b) {\n  for (;;) {\n   while (c) {\n    if (d) {\n     if (e) {\n     }\n    }\n    if (f) { g() }\n    if (h) {\n    }\n   }\n  }\n }\n}\nx = '{{{{{{'\ny = '}}}}}}'"),
    ("ts", "export async function big(a, b) {\n" + _filled(80, "  step({ a: '}' })") + "\n}\nconst small = (x) => {\n  return x\n}\nclass K {\n  run(a: number): void {\n" + _filled(79, "    go()") + "\n  }\n}"),
    ("js", "const huge = async (a) => {\n" + _filled(60, "  one()") + "\n  const inner = x => {\n" + _filled(90, "    two(\"{\")") + "\n  }\n}\nif (z) {\n" + _filled(85, " w()") + "\n}\nfunction open() {"),
    ("py", "from typing import Protocol\nclass Used(Protocol):\n    x: int\nclass Unused(Protocol):\n    y: int\n  class Deep(A, typing.Protocol):\n    z: int\nclass Gone(Protocol[T]): ...\nclass Out(Protocol): ...\n__all__ = ['Out', \"Used\"]\n# Unused_ is another name"),
    ("py", "def f():\n    try:\n        a()\n    except Exception:\n\n        # nothing\n        pass\n    b()\n    try:\n        a()\n    except ValueError:\n        pass\n    except (KeyError):\n        pass\n    try: a()\n    except A.B as c: pass\n    except D:\n        pass  # why\nexcept E:\n    if x:\n        pass"),
    ("txt", "eval(x)\nconst secret = 'q8ZsW3vT0rLmN4xKc7'"),
    ("ts", "export const fine = 1\n"),
)


def name_of(doc: Column) -> Column:
    """The file of a document."""
    kinds = F.array(*[F.lit(ext) for ext, _ in SNIPPETS])
    folder = F.element_at(F.array(*map(F.lit, ("src", "lib", "dist", "src/vendor"))), (doc % 4 + 1).cast("int"))
    return F.concat(folder, F.lit("/f"), doc, F.lit("."), F.element_at(kinds, (doc % len(SNIPPETS) + 1).cast("int")))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file, size, content)``: one file for each document of the table, with all of its text."""
    runtime.tune(spark)
    docs = runtime.spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    bodies = F.array(*[F.lit(body) for _, body in SNIPPETS])
    content = F.concat(F.element_at(bodies, (F.col("doc_id") % len(SNIPPETS) + 1).cast("int")), F.lit("\n"), F.coalesce("text", F.lit("")))
    return docs.where("doc_id is not null").select(name_of(F.col("doc_id")).alias("file"), F.octet_length(content).cast("long").alias("size"), content.alias("content"))


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(diff_id, diff)``: a unified diff for each document, which adds its lines to the file of the corpus."""
    all_files = files(spark, sf_dir)
    head = F.concat(F.lit("diff --git a/"), F.col("file"), F.lit(" b/"), F.col("file"), F.lit("\nindex 1..2 100644\n--- a/"), F.col("file"), F.lit("\n+++ b/"), F.col("file"), F.lit("\n@@ -1,2 +1,3 @@ x\n keep\n-gone\n+"))
    tail = F.lit("\n\\ No newline at end of file\n@@ -9 +40,2 @@\n+far\n same\n+end\ndiff --git a/x b/x\n+++ /dev/null\n@@ -1 +1 @@\n+lost\n")
    body = F.replace("content", F.lit("\n"), F.lit("\n+"))
    return all_files.select(F.col("file").alias("diff_id"), F.concat(head, body, tail).alias("diff"))
