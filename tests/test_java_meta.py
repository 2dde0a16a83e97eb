"""Java metadata expressions: comment stripping, code lines, package, public method signatures."""

from pyspark.sql import functions as F

from trellis.operators import java_meta

SRC = '''package a.b.c; // trailing
import java.util.*;
/** doc with public void fake() */
public abstract class K<T> {
    public static final List<String> NAMES = List.of("x");
    public K(int a) {}
    @Override public String toString() { return "public void inString()"; }
    public <R> Map<String, List<R>> group(List<? extends T> xs, int[] idx, String... rest) { return null; }
    public abstract void run(@Deprecated final String s);
    public boolean getFlag(int i) { return true; }
    public int getCount() { return 0; }
    public String setName(String n) { return n; }
    public void setAll(String a, String b) {}
    protected void hidden() {}
    static class Inner { public long size() { return 1L; } }
    String s = "/* not a comment */";
}
'''




def meta(spark, src):
    df = spark.createDataFrame([(1, "a/K.java", src), (2, "a/k.py", src)], "file_id long, file_path string, content string")
    out = {r.file_id: r for r in java_meta.with_java_metadata(df).collect()}
    assert out[2].code_lines is None and out[2].public_methods is None
    assert [r.file_id for r in java_meta.java_metadata(df).collect()] == [1]
    return out[1]


def test_strip_and_lines(spark):
    code = spark.range(1).select(java_meta.without_comments(F.lit(SRC))).first()[0]
    assert "doc with" not in code and "trailing" not in code
    assert '"/* not a comment */"' in code
    assert meta(spark, SRC).code_lines == 16


def test_block_comments_keep_line_breaks(spark):
    assert meta(spark, "int a; /* x\n y */ int b;\n/** z **/ int c;\n/* q *\n */ // t\n\n  \nint d; /* open").code_lines == 4
    assert meta(spark, None).code_lines == 0 and meta(spark, "'\"' /* c */ + \"//\"").code_lines == 1


def test_long_texts_do_not_recurse(spark):
    big = "/*" + "* x\n" * 100_000 + "*/ class A { String s = \"" + "ab\\\"" * 50_000 + "\"; }"
    assert meta(spark, big).code_lines == 1


def test_package_and_methods(spark):
    r = meta(spark, SRC)
    assert r.declared_package == "a.b.c"
    assert r.public_methods == [
        "toString()",
        "group(List<? extends T>, int[], String...)",
        "run(String)",
        "getFlag(int)",
        "setName(String)",
        "setAll(String, String)",
        "size()",
    ]


def test_no_package(spark):
    r = meta(spark, "class A {}\n")
    assert r.declared_package is None and r.public_methods == []


def _type(rnd, depth):
    """A random type as Java source with odd spacing and annotations, and as it is shown."""
    name = rnd.choice(["A", "List", "java.util.Map", "Outer$1", "_x"])
    note = rnd.choice(["", "", "@N ", "@a.b.C(x = {1, (2)}, y = @D(z = \"\")) "])
    if depth and rnd.random() < 0.8:
        args = [_type(rnd, depth - 1 if k == 0 else 0) for k in range(rnd.randrange(1, 13))]
        wild = [rnd.choice(["", "", "? extends ", "? super "]) for _ in args]
        gap = rnd.choice(["", " ", "\n\t"])
        name, shown = (f"{name}{gap}<{gap}" + f"{gap},{gap}".join(w + a for w, (a, _) in zip(wild, args)) + f"{gap}>",
                       f"{name}<" + ", ".join(w + b for w, (_, b) in zip(wild, args)) + ">")
    else:
        shown = name
    array = rnd.choice(["", "", "[]", "[][]"])
    return note + name + array, shown + array


def test_signatures_of_any_depth_and_width():
    """Generated methods: the signature is known by construction."""
    import random
    rnd = random.Random(11)
    for n in range(300):
        params, shown = [], []
        for i in range(rnd.randrange(0, 5)):
            source, text = _type(rnd, n % 8 + 1 if i == 0 else 1)
            tail, extra = rnd.choice([(f" p{i}", ""), (f" p{i}", ""), (f" p{i}[]", "[]"), (f"... p{i}", "...")])
            params.append(rnd.choice(["", "final ", "@Q final ", "@Q(1) "]) + source + tail)
            shown.append(text + extra)
        head = rnd.choice(["", " static", " final synchronized", " @Override @S({1})", " <T extends A<? super T> & B>", " abstract <K, V>"])
        result = rnd.choice(["void", "int[]", "Map<K, List<V[]>>", "a.b.C<?>.D"])
        name = rnd.choice(["get", "set", "run", "record", "publicly", "$f"])
        got = java_meta.signature(f"{head} {result} {name} (" + ", ".join(params) + ") throws X { int y = 1")
        left_out = name == "get" and not params or name == "set" and len(params) == 1 and result == "void"
        assert got == (None if left_out else f"{name}({', '.join(shown)})")


def test_heads_and_what_is_no_method(spark):
    src = """public class A<T> extends B<C<T>> implements D { public A(Map<String, int[]> m) { this.x = f(m); }
      static public final Map<String, Function<A, B>> TABLE = make(1); public int a = g(2), b = h(3);
      public record P(int a, List<int[]> b) { public P { check(a); } public int record(P... ps) { return 0; } }
      public enum E { X(1), Y(2); public static E of(int i) { return X; } }
      public @interface N { int value() default 1; }
      public sealed interface S permits Q { public default <X> void each(Consumer<? super X> c) { run(() -> c); } }
      publicly void no(int a); private void nor(int b); xpublic void nor2(); public void unclosed(Map<String x) { }
      @Deprecated(since = "1", forRemoval = (1 < 2)) public strictfp native void last(A this, final @N(1) int... é); }"""
    assert meta(spark, src).public_methods == ["record(P...)", "of(int)", "each(Consumer<? super X>)", "last(int...)"]


def test_hostile_code_takes_linear_time(spark):
    import time
    for piece in ("public <", "public void f(@A(", "public A<B<", "public void f(int a, ", "public @A(", "public ("):
        t = time.time()
        assert meta(spark, piece * 50_000).public_methods == [] and time.time() - t < 20
    deep = "public void f(" + "A<" * 20_000 + "B" + ">" * 20_000 + " x);"
    assert len(meta(spark, deep).public_methods[0]) == 2 * 20_000 + 20_000 + 4
