"""Thresholds, word lists and tables that results depend on."""

# fixed values: phrases that point at the screen, and phrases that move on
DEICTIC = [
    "look at", "here we see", "this graph", "notice", "observe",
    "check this", "see this", "here's", "look here",
]
NEGATIVE_DEICTIC = [
    "next slide", "moving on", "let's continue", "moving forward",
    "now let's", "next we'll", "moving to", "next topic",
]

# fixed values: points per rule and limits of the intervention score
SCORES = {"deictic": 50, "negative": -50, "silent": 80, "complex": 50}
COMPLEX_ABOVE = 0.30
SILENT_CHARS = 10
VISUAL_ONLY_ABOVE = 0.25
SCORE_MEDIUM = 50
SCORE_HIGH = 100

# fixed values: context width by mode, in seconds each way
CONTEXT_SECONDS = {"brief": 30, "explanatory": 60, "detailed": 120, "standard": 30}

# fixed values: concept words, in the order they are reported
CONCEPTS = [
    "derivative", "integral", "slope", "rate", "function",
    "velocity", "acceleration", "force", "energy", "power",
    "equation", "graph", "linear", "proportion", "ratio",
    "theorem", "principle", "law", "formula", "variable",
    "exponential", "logarithm", "probability", "matrix", "vector",
    "optimization", "symmetry", "equilibrium", "wave", "entropy",
    "limit", "continuity", "differentiation", "integration",
    "area", "volume", "surface", "curve", "line", "point",
    "angle", "triangle", "circle", "polygon", "geometry",
]

# fixed values: principles named with a concept
PRINCIPLES = {
    "derivative": ["rate of change", "slope", "instantaneous rate", "tangent line"],
    "integral": ["accumulation", "area", "total", "antiderivative", "summation"],
    "slope": ["rate of change", "derivative", "tangent", "gradient", "steepness"],
    "velocity": ["speed", "rate of motion", "derivative of position", "directional speed"],
    "acceleration": ["rate of velocity change", "derivative of velocity", "second derivative of position"],
    "force": ["mass times acceleration", "newton's second law", "push or pull", "interaction"],
    "energy": ["work", "power", "capacity", "potential", "kinetic energy"],
    "linear": ["proportional", "direct relationship", "constant rate", "straight line"],
    "exponential": ["rapid growth", "compound growth", "multiplicative change"],
    "logarithm": ["inverse of exponential", "scale compression", "orders of magnitude"],
    "probability": ["likelihood", "chance", "random event", "distribution"],
    "matrix": ["array", "linear transformation", "system of equations", "data structure"],
    "vector": ["direction and magnitude", "multi-dimensional quantity", "arrow representation"],
    "equilibrium": ["balance point", "stable state", "forces balance", "no net change"],
    "optimization": ["maximization", "minimization", "best solution", "extremum finding"],
    "symmetry": ["invariance", "reflection", "rotation", "mirror image", "balance"],
    "wave": ["oscillation", "periodic", "frequency", "amplitude", "propagation"],
    "entropy": ["disorder", "randomness", "uncertainty", "information content"],
    "limit": ["approach value", "convergence", "boundary value", "tends to"],
    "continuity": ["no breaks", "smooth", "connected", "uninterrupted"],
    "differentiation": ["finding derivative", "rate of change", "slope finding"],
    "integration": ["finding integral", "accumulation", "area calculation"],
    "area": ["space covered", "region", "surface measure", "planar extent"],
    "volume": ["3D space", "capacity", "cubic measure", "space occupied"],
    "angle": ["rotation", "opening", "geometric figure", "vertex measure"],
}

# fixed values: words that tell a topic; the first topic with a hit wins
TOPICS = {
    "equations": ["equation", "solve", "equals", "formula", "variable", "unknown"],
    "graphs": ["graph", "plot", "curve", "axis", "coordinate", "intersection", "slope"],
    "theorems": ["theorem", "principle", "law", "proof", "corollary", "lemma"],
    "functions": ["function", "mapping", "input", "output", "domain", "range"],
    "calculus": ["derivative", "integral", "limit", "differentiate", "integrate"],
    "geometry": ["triangle", "circle", "angle", "polygon", "area", "volume", "perimeter"],
    "probability": ["probability", "chance", "random", "distribution", "expected value"],
    "linear_algebra": ["matrix", "vector", "determinant", "eigenvalue", "transformation"],
    "statistics": ["mean", "median", "mode", "standard deviation", "variance", "distribution"],
    "physics": ["force", "velocity", "acceleration", "energy", "momentum", "work"],
}

# fixed values: domains asked for when a concept is explained across domains
DOMAINS = ["math", "physics", "chemistry", "economics", "biology"]

# fixed values: words that must not be read out of a picture of this type
MISMATCHES = {
    "equation": ["person", "man", "woman", "face", "people", "teacher"],
    "graph": ["person", "man", "woman", "face", "people"],
    "circuit": ["person", "man", "woman", "face", "text", "paragraph"],
    "code": ["person", "face", "diagram", "graph"],
    "diagram": ["person", "man", "woman", "face", "text", "paragraph"],
    "biology": ["equation", "graph", "code"],
    "chemistry": ["equation", "graph", "code"],
    "text": ["circuit", "equation", "graph", "code"],
}

# fixed values: (substring of the content type, category), first hit wins
CATEGORY_LADDER = [
    ("equation", "equation"), ("graph", "graph"), ("circuit", "circuit"), ("diagram", "diagram"),
    ("code", "code"), ("handwritten", "handwritten_notes"), ("biology", "biology"),
    ("chemistry", "chemistry"), ("physics", "physics"), ("slide", "slide"), ("table", "table"),
    ("text", "text"),
]
CATEGORIES = [name for _, name in CATEGORY_LADDER] + ["unknown"]

# fixed values: subject by dominant content type
SUBJECTS = {
    "equation": "Mathematics", "graph": "Mathematics", "geometry": "Mathematics", "biology": "Biology",
    "chemistry": "Chemistry", "circuit": "Physics", "diagram": "Science", "code": "Computer Science",
    "table": "General", "flowchart": "General", "text": "General", "slide": "General", "notes": "General",
}

# fixed values: weights of the complexity score
COMPLEXITY_WEIGHTS = {"edge": 0.30, "text": 0.25, "contrast": 0.20, "gradient": 0.15, "colour": 0.10}

# fixed values: notation patterns in order, with \\1-style groups
MATH_PATTERNS = [
    (r"([a-zA-Z])_([0-9]+)", r"\1 sub \2"),
    (r"([a-zA-Z])\^([0-9]+)", r"\1 to the power of \2"),
    (r"∫_([a-zA-Z0-9]+)\^([a-zA-Z0-9]+)(.+?)dx", r"the integral from \1 to \2 of \3 with respect to x"),
    (r"∫\s*(.+?)dx", r"the integral of \1 with respect to x"),
    (r"∫\s*(.+)", r"the integral of \1"),
    (r"(\d+)/(\d+)", r"\1 divided by \2"),
    (r"([a-zA-Z]+)/([a-zA-Z])", r"\1 divided by \2"),
    (r"([a-zA-Z])\(([a-zA-Z0-9,]+)\)", r"\1 of \2"),
    (r"d([a-zA-Z])/d([a-zA-Z])", r"the derivative of \1 with respect to \2"),
    (r"d\^2([a-zA-Z])/dx\^2", r"the second derivative of \1 with respect to x"),
]

# fixed values: symbols and their spoken form, in order; alphabetic ones match whole words
MATH_SYMBOLS = [
    ("²", "squared"), ("³", "cubed"), ("^2", " to the power of 2"), ("^3", " to the power of 3"),
    ("^n", " to the power of n"), ("^-1", " to the power of negative one"),
    ("^-2", " to the power of negative two"), ("_", " sub "),
    ("∫", "the integral from"), ("∫∫", "the double integral of"), ("∮", "the closed integral of"),
    ("∑", "the summation of"), ("∑∑", "the double summation of"), ("∏", "the product of"),
    ("∂", "the partial derivative of"), ("∇", "the gradient of"), ("∆", "delta"), ("Δ", "delta"),
    ("θ", "theta"), ("π", "pi"), ("φ", "phi"), ("ψ", "psi"), ("λ", "lambda"), ("μ", "mu"),
    ("σ", "sigma"), ("ω", "omega"), ("α", "alpha"), ("β", "beta"), ("γ", "gamma"), ("δ", "delta"),
    ("ε", "epsilon"), ("ζ", "zeta"), ("η", "eta"), ("κ", "kappa"), ("ν", "nu"), ("ξ", "xi"),
    ("ρ", "rho"), ("τ", "tau"), ("υ", "upsilon"), ("χ", "chi"),
    ("√", "the square root of"), ("∛", "the cube root of"), ("≈", "approximately equal to"),
    ("≤", "less than or equal to"), ("≥", "greater than or equal to"), ("≠", "not equal to"),
    ("≡", "identical to"), ("→", "tends to"), ("⇒", "implies"), ("⇐", "is implied by"),
    ("⇔", "if and only if"), ("∞", "infinity"), ("÷", "divided by"), ("×", "times"),
    ("±", "plus or minus"), ("∓", "minus or plus"), ("∴", "therefore"), ("∵", "because"),
    ("∃", "there exists"), ("∀", "for all"), ("∈", "in"), ("∉", "not in"), ("⊂", "subset of"),
    ("⊆", "subset of or equal to"), ("∪", "union"), ("∩", "intersection"), ("∅", "empty set"),
    ("ℝ", "the set of real numbers"), ("ℕ", "the set of natural numbers"), ("ℤ", "the set of integers"),
    ("ℚ", "the set of rational numbers"), ("ℂ", "the set of complex numbers"),
    ("e", "the mathematical constant e"), ("f(x)", "f of x"), ("g(x)", "g of x"), ("sin", "sine"),
    ("cos", "cosine"), ("tan", "tangent"), ("log", "logarithm"), ("ln", "natural logarithm"),
    ("lim", "limit"),
]
MATH_CALL = (r"([a-zA-Z])\(([a-zA-Z])\)", r"\1 of \2")
MATH_OPERATORS = [
    ("=", "equals"), ("+", "plus"), ("-", "minus"), ("*", "times"), ("/", "divided by"),
    ("to the power of 2 plus", "squared plus"), ("to the power of 3 plus", "cubed plus"),
]

# fixed values: video id patterns by policy, tried in order
VIDEO_ID_PATTERNS = {
    "strict": [r"(?:youtube\.com/(?:watch\?v=|embed/|shorts/)|youtu\.be/)([\w-]{11})"],
    "lenient": [
        r"(?:youtube\.com\/watch\?v=|youtu\.be\/|youtube\.com\/embed\/|youtube\.com\/v\/)([a-zA-Z0-9_-]{11})"
    ],
    "batch": [r"(?:v=|/v/|youtu\.be/)([a-zA-Z0-9_-]{11})", r"([a-zA-Z0-9_-]{11})"],
    "client": [
        r"(?:youtube\.com\/watch\?(?:.*&)?v=)([a-zA-Z0-9_-]{11})",
        r"(?:youtu\.be\/)([a-zA-Z0-9_-]{11})",
        r"(?:youtube\.com\/shorts\/)([a-zA-Z0-9_-]{11})",
        r"(?:youtube\.com\/embed\/)([a-zA-Z0-9_-]{11})",
    ],
}
