"""These word lists decide results and must keep exactly these members."""

# Fixed values. English function words counted by the prose test.
PROSE_STOPWORDS = (
    "the a an to of is are was were and or in for that this with if not be been "
    "being will can could should must you your it its on from as by at has have "
    "had when which there their any all does do no yes than then these those we "
    "our us he she they them such use using used into over under about after "
    "before between each other more most some only also but so because while "
    "where what who how does"
).split()

# Fixed values. A line headed by one of these names no program.
FUNCTION_WORD_HEADS = (
    "a an and are as at be been being but by can could did do does done else "
    "for from had has have how however if in into is it its may might must no not "
    "of on or other our over should so such than that the their them then there "
    "these they this those to was we were what when where while whom "
    "whose why will with would you your "
    "case done elif esac fi then while until do"
).split()

# Fixed values. The shell keywords among the heads above.
SHELL_KEYWORD_HEADS = "case do done elif else esac fi for if then until while".split()

# Fixed values. Opening verbs and nouns of interactive-screen instructions.
TUI_OPENERS = (
    "select choose press click navigate highlight scroll "
    "type enter tab arrow confirm accept expand collapse"
).split()
TUI_WORDS = (
    "menu screen dialog wizard field button tab prompt "
    "window installer anaconda nmtui cursor checkbox key "
    "keys arrow option list"
).split()

# Fixed values. Program names trusted without corpus evidence.
COMMON_BINARIES = (
    "apropos aureport authconfig basename bash cat chattr "
    "chcon chgrp chmod chown chpasswd cp crontab cut "
    "date dd df diff dirname dmesg dnf dracut du "
    "echo egrep env fgrep file find free getfacl "
    "getcap grep groupadd groupdel groupmod gzip head "
    "hostname id kill killall ln locate ls lsattr "
    "lscpu lsmod lsof man mkdir mktemp modprobe more "
    "mount mv netstat nice nohup passwd ping ps pwd "
    "readlink realpath rm rmdir rpm rsync scp sed "
    "setfacl sh sort ss ssh stat strings su sync "
    "tail tar tee test top touch tr tune2fs udevadm "
    "umask umount uname uniq unzip uptime vim w wc "
    "wget which who whoami xargs zcat"
).split()

# Fixed values. Heads whose command is a quoted string argument; never mined.
REFUSED_HEADS = "su sh bash ksh zsh dash env chroot eval".split()

# Fixed values. Wrappers that stand in front of the program, with those of their
# options that take a separate argument.
WRAPPER_ARG_OPTIONS = {
    "sudo": "-u -g -p -C -U -r -t -h -D -R --user --group --prompt --role --type "
            "--close-from --host --chdir --chroot".split(),
    "doas": "-u -C".split(),
    "nohup": [],
    "xargs": "-I -i -n -P -d -E -e -s -a -L -l --replace --max-args --max-procs "
             "--delimiter --eof --max-chars --arg-file --max-lines".split(),
    "timeout": "-s -k --signal --kill-after".split(),
}
# Fixed values. Wrappers with one positional argument of their own, and wrapper
# options that start a shell, so that the wrapper itself is the program.
WRAPPERS_WITH_POSITIONAL = ["timeout"]
WRAPPER_SHELL_OPTIONS = "-s -i --shell --login -c".split()

# Fixed values. Directories whose absolute paths count as programs.
BIN_DIRS = (
    "/bin/ /sbin/ /usr/bin/ /usr/sbin/ /usr/local/bin/ "
    "/usr/local/sbin/ /usr/libexec/ /usr/X11R6/bin/ /opt/"
).split()

# Fixed values. Long options that may end a complete line.
NO_VALUE_LONG_OPTIONS = (
    "--all --help --version --list --quiet --verbose --force "
    "--now --permanent --reload --live --system --user --json "
    "--yes --no-gpg-verify --dry-run --check --debug --full "
    "--recursive --long --raw --no-pager --global --local "
    "--enable --disable --status --start --stop --restart "
    "--syntax-check --verify --update --query --install --remove"
).split()

# Fixed values. The closed set of reasons for declining a line.
RESIDUE_REASONS = (
    "prose interactive-tui output-fragment config-fragment unparseable binary-not-on-release"
).split()

# Fixed values. Code point ranges that must not appear raw in text.
INVISIBLE_RANGES = [
    (0x00, 0x08), (0x0B, 0x0C), (0x0E, 0x1F), (0x7F, 0x9F),
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C),
    (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180E),
    (0x200B, 0x200F), (0x2028, 0x2029), (0x202A, 0x202E),
    (0x2060, 0x206F),
    (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0),
]

# Fixed values. Words that change system state.
STATE_CHANGE_WORDS = "install remove erase enable start stop add del".split()
STATE_CHANGE_FLAGS = ["--permanent"]

# Fixed values. Where a redirect may write, by rating.
SCRATCH_DIRS = "/tmp /var/tmp /home /root".split()
SYSTEM_DIRS = "/etc /boot /dev /usr /var/lib /sys /proc".split()

# Fixed values. Words that open a sentence rather than a definition-list term, and
# verbs that open a description rather than an argument name.
DESCRIPTION_VERBS = (
    "specifies specify sets set enables enable disables "
    "disable allows allow turns prints print shows "
    "show runs run avoid display displays get gets "
    "use uses used do does generates generate include "
    "includes resolve resolves continue delete deletes "
    "reset resets equivalent test tests write writes"
).split()

# Fixed values. Words kept lower-case inside a title.
TITLE_SMALL_WORDS = "and or the a an to of in for on with using".split()

# Fixed values. Words that open a sentence rather than a definition-list term.
SENTENCE_STARTERS = (
    "see note notes this the for when if by as "
    "it each some many most also in on with use "
    "using a an these those unless while after "
    "before however instead note: warning caution example "
    "examples default defaults since because note,"
).split()
