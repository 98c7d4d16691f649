"""Fixed values as the SQL states them: what lines, handlers and terms are known by. Written out here, not taken from the operators."""

SPINNERS = (
    "⠋", "⠙", "⠹", "⠸", "⠼", "⠴", "⠦", "⠧", "⠇", "⠏",
)
NPM_NOISE = (
    "npm warn deprecated", "WARN deprecated", "npm notice", "npm warn EBADENGINE",
)
BUNDLER_NOISE = (
    "[tsconfig-paths]", "The plugin \"vite-tsconfig-paths\"", "The plugin \"@vitejs/plugin-react\"",
    "Vite now supports tsconfig paths resolution natively", "You can remove the plugin and set resolve.tsconfigPaths",
    "For new projects, use create-next-app to choose", "`next lint` is deprecated",
)
ERROR_MARKERS = (
    "error:", "Error:", "ERROR:", "error[", "Error[", "panic", "Panic", "PANIC", "fatal:", "Fatal:", "FATAL:", "failed", "Failed", "FAILED",
    "Traceback", "traceback", "Exception", "exception",
)
ERROR_STARTS = (
    "error:", "Error:", "error[", "FAILED", "fatal:", "panic:",
)
GRADLE_NOISE = (
    "> Task :", "Executing ", "Download ",
)
XCODE_NOISE = (
    "ClangStatCache ", "RegisterExecutionPolicyException ", "RegisterWithLaunchServices ", "WriteAuxiliaryFile ", "MkDir ", "CreateBuildDirectory ",
    "ProcessInfoPlistFile ", "CpResource ", "CopySwiftLibs ", "PBXCp ", "SwiftEmitModule ", "SwiftDriverJobDiscovery ", "SwiftCompile ",
    "SwiftMergeGeneratedHeaders ", "CompileC ", "CompileAssetCatalog ", "CompileStoryboard ", "CompileXIB ", "LinkStoryboards ", "GenerateDSYMFile ",
    "Ld ", "CodeSign ", "Touch ", "Validate ", "ComputePackagePrebuildTargetDependencyGraph", "SendPIFToBuildSystem", "CreateBuildRequest",
    "Analyze workspace", "Create build description", "Build description signature:", "Build description path:", "Command line invocation:",
    "Build settings from command line:", "    cd /", "    builtin-", "    /Applications/Xcode.app/", "    /usr/bin/", "    export ",
)
XCODE_NOTES = (
    "note: Using new build system", "note: Using codesigning identity override", "note: Build preparation complete", "note: Planning",
)
NEXT_NOISE = (
    "▲ Next.js", "- Experiments (use with caution)", "Attention: Next.js now collects", "https://nextjs.org/telemetry",
    "Creating an optimized production build", "Compiled successfully", "Collecting page data", "Generating static pages",
    "Finalizing page optimization", "Collecting build traces",
)
WRANGLER_NOISE = (
    "⛅️ wrangler", "-------------------", "Total Upload:", "Worker Startup Time:", "No bindings found.",
    "Your Worker has access to the following bindings:", "Proxy server listening", "Ready on http://",
)
PLAYWRIGHT_NOISE = (
    "attachment #", "Slow test file:", "To open last HTML report",
)
HELM_NOISE = (
    "CHART:", "LAST DEPLOYED:", "NAMESPACE:", "STATUS:", "REVISION:", "TEST SUITE:", "---", "# Source:",
)
TERRAFORM_STARTS = (
    "+", "-", "~", "Plan:", "Apply complete!", "Destroy complete!", "Error:", "Warning:",
)
TERRAFORM_PARTS = (
    "changes to perform", "will be created", "will be destroyed", "will be updated",
)
ENV_NOISE = (
    "PATH=", "LS_COLORS=", "TERM=", "PS1=", "PROMPT=", "MANPATH=",
)
PRISMA_PARTS = (
    "generated prisma client", "error", "warning", "✔", "✓",
)
DIAGNOSTIC = (
    "error", "warning", "failed", "fatal", "panic", "exception",
)
STOP = (
    "the", "and", "for", "this", "that", "with", "from", "into", "was",
)
HANDLERS = {
    "git": ("git",),
    "docker": ("docker", "docker-compose", "podman"),
    "package_mgr": ("npm", "pnpm", "yarn"),
    "test_runner": ("jest", "vitest", "pytest", "py.test", "nextest"),
    "playwright": ("playwright",),
    "typescript": ("tsc", "eslint", "biome"),
    "build": ("make", "cmake", "gradle", "mvn", "xcodebuild"),
    "wrangler": ("wrangler",),
    "cloud": ("kubectl", "gh", "aws", "gcloud", "az"),
    "database": ("psql", "prisma", "mysql", "drizzle-kit"),
    "network": ("curl", "wget", "http"),
    "runtime": ("node", "python", "python3", "ruby"),
    "fs": ("find", "ls", "du", "ps", "env", "lsof", "netstat", "cat", "head", "tail", "less", "more", "bat"),
    "data_tool": ("jq", "yq", "terraform", "tofu", "helm", "pulumi"),
    "text_proc": ("grep", "rg", "awk", "sed"),
}
PYTHON_STARTS = (
    "def ", "async def ", "class ",
)
